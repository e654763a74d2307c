"""Secret scans: a keyword automaton finds where to look, anchored expressions look there, checksums decide.

An Aho-Corasick automaton reads each text once, with its ASCII letters lowered, and gives every keyword
hit; the expression of a hit's kind is then matched at that place only. Kinds:

- assign, access, hex: the base kinds of the contract (`hex` has no keyword: its runs are searched);
- github, npm: tokens whose last six characters are the base-62 CRC32 of those before; kept only if it holds.

Defined results: a null or empty text has no spans; rows keep their number and order within a
partition, repeated or not; spans of different kinds may overlap, and at one start come in the order of `KINDS`; a very long
text is searched whole; `redacted` keeps every row and order, a null text stays null, overlapping spans are masked as one; an
empty table gives no rows; input columns beside doc_id and text are not
read by `scanned` and are passed on by `redacted`, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import worker_memory

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm")
#: Keyword (lower case) and kind.
KEYWORDS = (
    ("password", "assign"), ("passwd", "assign"), ("secret", "assign"), ("token", "assign"), ("api_key", "assign"), ("apikey", "assign"),
    ("akia", "access"), ("ghp_", "github"), ("gho_", "github"), ("ghu_", "github"), ("ghs_", "github"), ("ghr_", "github"), ("npm_", "npm"),
)
#: Letters of the keywords in either case, ASCII only.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BATCH = 2_000
MASK = "[SECRET]"


def checksum(body: str) -> str:
    """CRC32 in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


def _automaton():
    kept = worker_memory()
    if not hasattr(kept, "secrets"):
        import ahocorasick

        found = ahocorasick.Automaton()
        for word, kind in KEYWORDS:
            found.add_word(word, (len(word) - 1, kind))
        found.make_automaton()
        kept.secrets = found
    return kept.secrets


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind; leftmost, none overlapping its own kind."""
    if not text:
        return []
    lowered = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = sorted((end - back, kind) for end, (back, kind) in _automaton().iter(lowered))
    found, free = [], dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < free[kind]:
            continue
        m = (_ASSIGN if kind == "assign" else _ACCESS if kind == "access" else _CHECKED).match(text, at)
        if not m:
            continue
        free[kind] = m.end()
        if len(m[1]) >= 6 if kind == "assign" else m.end() - at >= 20 if kind == "access" else checksum(m[1]) == m[2]:
            found.append((kind, at, m.end()))
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scanned(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id and spans, an array of (kind, start, end)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t.as_py())] for t in batch.column(1)]
                yield pa.record_batch([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def digested(found: DataFrame) -> DataFrame:
    """Columns of the contract from spans."""
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def masked(text: str | None) -> str | None:
    """The text with every span, overlapping ones as one, replaced by MASK."""
    out, at = [], 0
    for _, start, end in spans(text):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:] if at else text


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with secrets masked in text; n_chars, if there, follows."""

    @F.pandas_udf(T.StringType())
    def clean(texts):
        return texts.map(masked, na_action="ignore")

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
