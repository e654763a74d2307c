"""Quality rules and ranking, language, secrets, decontamination."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language_id, quality_rank, quality_rules, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """Base measures by brute force."""
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    n, rep = len(words), len(covered)
    return (n, sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n)


def test_quality_rules_against_brute_force(spark, hard):
    rng = random.Random(1)
    made = [" ".join(rng.choice(["a", "b", "c\n", "c d\ne", "|"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(made)], "doc_id long, text string")
    df = hard.unionByName(extra, allowMissingColumns=True)
    got = quality_rules.judged(df, "q_").collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.q_base_failed) == base(r.text)
        assert not (r.q_base_failed and r.q_kept)


#: Common words of the made-up prose below, in falling order.
COMMON = {"de": "der die und in den von zu das mit sich", "en": "the of and to a in is that it for", "es": "de la que el en y los se las del", "fr": "de la le et les des en un du une"}


def prose(rng, lang, n):
    common = COMMON[lang].split()
    shares = [1 / k for k in range(1, 11)]
    out = []
    for i in range(n):
        w = rng.choices(common, shares)[0] if rng.random() < 0.2 else "".join(rng.choice("aeinorstlhd") for _ in range(rng.randint(4, 8)))
        out.append((w.capitalize() if i % 12 == 0 else w) + ("." if i % 12 == 11 else ""))
    return " ".join(out)


def test_references_against_brute_force(spark):
    rng = random.Random(21)
    rows = [(i, prose(rng, lang, 20 + i % 40), lang) for i, lang in enumerate(["de", "en"] * 30 + ["fr"] * 19)] + [(500, "short one", "en"), (501, None, "en"), (502, prose(rng, "es", 30), None)]
    refs = quality_rules.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(refs.classes) == {"de", "en"}  # too few of fr
    for lang in refs.classes:
        texts = [t for _, t, k in rows if k == lang and t and len(t.split()) >= 20]
        words = Counter(w.lower() for t in texts for w in t.split())
        total = sum(words.values())
        only = [(w, n) for w, n in words.items() if w.isalpha()]
        assert list(refs.words[lang]) == [(w, n / total) for w, n in sorted(only, key=lambda x: (-x[1], x[0]))[:10]]
        middle = []
        for kind in (str.islower, str.isupper, str.isdigit, str.isspace, lambda c: c in "#*$%&|<>", lambda c: c == ".", lambda c: ord(c) > 127):
            shares = sorted(int(1000 * sum(map(kind, t)) / len(t) + 1e-9) for t in texts)
            middle.append(shares[(len(shares) - 1) // 2])
        assert refs.classes[lang] == pytest.approx([m / sum(middle) for m in middle])


def distance(p, q):
    """Jensen-Shannon distance, base 2, by its definition."""
    def kl(a, b):
        return sum(x * np.log2(x / y) for x, y in zip(a, b) if x > 0)

    mid = [(x + y) / 2 for x, y in zip(p, q)]
    return np.sqrt(max(0, (kl(p, mid) + kl(q, mid)) / 2))


def test_distances_against_brute_force(spark):
    rng = random.Random(22)
    refs = quality_rules.References({"a": (0.7, 0.05, 0.0, 0.2, 0.0, 0.05, 0.0), "b": (0.5, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1)}, {"a": (("the", 0.1), ("of", 0.05)), "b": (("der", 0.2),)})
    texts = [" ".join(rng.choice(["the", "Of", "DER", "der", "xyz", "4#", "é.", "Qq"]) for _ in range(rng.randint(1, 90))) for _ in range(80)]
    got = quality_rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), references=refs).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        words = [w.lower() for w in t.split()]
        kinds = [lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", str.isspace, lambda c: c in "#*$%&|<>", lambda c: c == ".", lambda c: ord(c) > 127]
        p = [sum(map(k, t)) / len(t) for k in kinds]
        by_class = min(distance(p, q) for q in refs.classes.values())
        by_word = []
        for x in refs.words.values():
            own = [words.count(w) / len(words) for w, _ in x]
            by_word.append((distance([*own, 1 - sum(own)], [*(s for _, s in x), 1 - sum(s for _, s in x)]), sum(own) / sum(s for _, s in x)))
        nearest = min((d for d, known in by_word if known >= 0.25), default=None)
        assert r.class_distance == pytest.approx(by_class) and r.word_distance == (None if nearest is None else pytest.approx(nearest))
        n = len(words)
        far = p[6] <= 0.2 and by_class > 0.14 + 0.47 / n**0.5 or n >= 50 and nearest is not None and nearest > 0.2 + 1.35 / n**0.5
        assert r.kept == (not r.base_failed and not far)


#: Plain prose, written for this test.
PROSE = {
    "en": "The house at the end of the lane had been empty since the spring, and nobody in the village could say with certainty who held the key. In the evenings the children dared each other to climb the wall, to look through the dusty windows and to run back before the dog of the neighbour heard them. It was said that a captain had lived there, that he had brought strange birds from the south, and that one of them still sang in the garden when it was about to rain.",
    "de": "Das Haus am Ende der Gasse stand seit dem Frühling leer, und niemand im Dorf konnte mit Sicherheit sagen, wer den Schlüssel hatte. Am Abend forderten sich die Kinder heraus, über die Mauer zu klettern, durch die staubigen Fenster zu sehen und zurück zu laufen, bevor der Hund des Nachbarn sie hörte. Man erzählte sich, dass ein Kapitän dort gewohnt und seltsame Vögel aus dem Süden mitgebracht hatte und dass einer von ihnen noch immer in dem Garten sang, wenn es zu regnen begann.",
    "fr": "La maison au bout de la ruelle était vide depuis le printemps, et personne dans le village ne pouvait dire avec certitude qui en avait la clé. Le soir, les enfants se mettaient au défi de grimper sur le mur, de regarder par les fenêtres poussiéreuses et de revenir en courant avant que le chien du voisin ne les entende. On disait qu'un capitaine y avait vécu, qu'il avait ramené des oiseaux étranges du sud, et que l'un d'eux chantait encore dans le jardin quand la pluie allait tomber.",
    "es": "La casa al final de la calle estaba vacía desde la primavera, y nadie en el pueblo podía decir con certeza quién tenía la llave. Por las tardes los niños se retaban a trepar el muro, a mirar por las ventanas llenas de polvo y a volver corriendo antes de que el perro del vecino los oyera. Se decía que un capitán había vivido allí, que había traído pájaros extraños del sur y que uno de ellos cantaba todavía en el jardín cuando iba a llover.",
    "it": "La casa in fondo al vicolo era vuota dalla primavera, e nessuno nel paese poteva dire con certezza chi avesse la chiave. La sera i bambini si sfidavano ad arrampicarsi sul muro, a guardare dalle finestre piene di polvere e a tornare di corsa prima che il cane del vicino li sentisse. Si diceva che un capitano ci avesse vissuto, che avesse portato strani uccelli dal sud e che uno di loro cantasse ancora nel giardino quando stava per piovere.",
    "ru": "Дом в конце переулка стоял пустым с самой весны, и никто в деревне не мог сказать наверняка, у кого хранится ключ. По вечерам дети подбивали друг друга залезть на стену, заглянуть в пыльные окна и убежать назад, пока их не услышала собака соседа. Говорили, что там жил капитан, что он привёз с юга странных птиц и что одна из них всё ещё поёт в саду, когда собирается дождь.",
    "notes": "Build notes, version 2.4 (March 2021). Install the tool with one command and run it in the folder of your project; the first run takes about 30 seconds. Options: -v prints more, -q prints less, --out FILE writes the report to a file. If a test fails, the tool stops and shows the line where it went wrong. Please report bugs by mail, and add the output of the last run. This software is free: you may copy it, change it and pass it on, as long as this notice stays in place.",
}


def test_references_learn_from_every_document(spark):
    """12,000 documents, of which one in 6,000 has a word or a character that no other has."""
    rng = random.Random(22)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(19)) + (" rare" if i % 6000 == 0 else " x"), "en") for i in range(12_000)]
    rows += [(20_000 + i, "word " * 20 + "9" * (i % 40), f"lang{i % 30:02}") for i in range(30 * 25)]
    refs = quality_rules.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    words = Counter(w for _, t, k in rows if k == "en" for w in t.split())
    want = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert refs.words["en"] == tuple((w, n / 240_000) for w, n in want)
    assert list(refs.classes) == ["en", *(f"lang{i:02}" for i in range(19))]  # by documents, then by name


def test_plain_prose_is_kept(spark):
    """By references of the corpus: prose of its languages, of a language and a script without a reference, and a technical text; not junk of the same words."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    refs = quality_rules.learned(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert set(refs.classes) == {"de", "en", "es", "fr"}
    junk = {"symbols": "$$$ ".join(PROSE["en"].split()), "bars": " | ".join(PROSE["de"].split()), "digits": " 8 ".join(PROSE["fr"].split()), "capitals": PROSE["en"].upper(), "stuffed": " ".join(f"{w} the the" for w in PROSE["en"].split())}
    texts = [*PROSE.values(), *junk.values()]
    got = quality_rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), references=refs).orderBy("doc_id").collect()
    assert {k: r.kept for k, r in zip([*PROSE, *junk], got)} == {**dict.fromkeys(PROSE, True), **dict.fromkeys(junk, False)}


def test_divergence_keeps_prose_and_rejects_junk(spark):
    rng = random.Random(2)
    refs = quality_rules.learned(spark.createDataFrame([(i, prose(rng, "en", 200), "en") for i in range(30)], "doc_id long, text string, lang string"))
    clean = [prose(rng, "en", n) for n in (30, 80, 150, 600)]
    junk = ["$$$ ".join(prose(rng, "en", 300).split()), prose(rng, "en", 300).upper() + "!!", " ".join("| " + "".join(rng.choice("aeinorst") for _ in range(7)) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    assert [r.kept for r in quality_rules.judged(df, references=refs).orderBy("doc_id").collect()] == [True] * 4 + [False] * 3
    assert quality_rules.kept(df, refs).columns == ["doc_id", "text"] and quality_rules.kept(df).count() == 7


def test_quality_rules_without_rows(empty):
    assert quality_rules.judged(empty, "q_").count() == 0 and quality_rules.kept(empty).columns == empty.columns


def test_ranking(spark, hard, empty):
    rng = random.Random(3)
    good, bad = [prose(rng, "en", rng.randint(60, 200)) for _ in range(300)], ["| ".join(prose(rng, "en", rng.randint(60, 200)).split()) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)] + [(0, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    ranker = quality_rank.fit(docs, labels, F.col("doc_id") % 4 != 2)
    got = quality_rank.scored(docs, ranker).collect()
    held = [r for r in got if r.doc_id % 4 == 2]
    assert np.mean([(r.score >= quality_rank.CUT) == (r.doc_id < 300) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    scored = quality_rank.scored(hard, ranker)
    assert scored.count() == hard.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality_rank.scored(empty, ranker).count() == 0
    none = quality_rank.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_rank.scored(hard, none).collect()} == {0.5}


def test_ranking_against_brute_force(spark):
    """Measures by plain loops, the gradient by all pairs, the threshold by the quantile of the sample's scores."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["Alpha", "beta", "7", "#x", "é", "line\n", "same same"]) for _ in range(rng.randint(1, 60))) for _ in range(120)] + ["", None, "\n\n", "one"]
    for t in texts:
        got = dict(zip(quality_rank.MEASURES, quality_rank.measures(t)))
        raw, words = (t or "").encode(), (t or "").split()
        share = lambda chars: sum(c in chars for c in raw) / len(raw) if raw else 0.0
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert got["upper"] == pytest.approx(share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) and got["digit"] == pytest.approx(share(b"0123456789")) and got["symbol"] == pytest.approx(share(b"#*$%&|<>"))
        assert got["high"] == pytest.approx(share(bytes(range(128, 256)))) and got["log_words"] == pytest.approx(np.log1p(len(words)))
        if words:
            assert got["repeated_words"] == pytest.approx(len(covered) / len(words)) and got["repeated_lines"] == pytest.approx(1 - len(set(lines)) / len(lines))
            assert got["distinct"] == pytest.approx(len(set(words)) / len(words)) and got["top_word"] == pytest.approx(max(Counter(words).values()) / len(words))
    a, b = np.random.default_rng(1).normal(1, 2, 200), np.random.default_rng(2).normal(-1, 2, 150)
    for mine, other, sign in ((a, b, 1), (b, a, -1)):
        want = [np.mean([1 / (1 + np.exp(sign * (x - y))) for y in other]) for x in mine]
        assert quality_rank.pull(mine, other, sign) == pytest.approx(want, abs=1e-4)
    assert quality_rank.pull(np.zeros(3), np.zeros(2), 1) == pytest.approx([0.5] * 3)
    x = np.array([quality_rank.measures(t) for t in texts], float)
    label = np.array([int(i % 3 > 0 or m[0] > 3) for i, m in enumerate(x)])
    ranker = quality_rank.fit_pairs(x, label)
    raw = [sum(ranker.weights[k][int((v >= ranker.edges[k]).sum())] for k, v in enumerate(row)) for row in x]
    assert ranker.raw(x) == pytest.approx(raw)
    low = round((1 - label.mean()) * len(x))
    assert ranker.zero == pytest.approx((sorted(raw)[low - 1] + sorted(raw)[low]) / 2, abs=1e-4)
    assert ((ranker.score(x) >= quality_rank.CUT) == (np.array(raw) >= ranker.zero)).all()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "another text of this id")]
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(label)], "doc_id long, quality int")
    one, two = (quality_rank.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, F.lit(True)) for r, n in ((rows, 3), (rows[::-1], 5)))
    assert (one.weights == two.weights).all() and one.zero == two.zero


def test_ranking_learns_from_every_label(spark):
    """12,000 labelled documents: the share of quality 1, and the quantile bins' edges, are those of all."""
    texts = [" ".join(["word"] * (1 + i % 997)) for i in range(12_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(12_000)], "doc_id long, quality int")
    ranker = quality_rank.fit(docs, labels, F.lit(True))
    assert ranker.base == 8_000 / 12_000
    want = np.quantile(np.log1p(1 + np.arange(12_000) % 997), np.arange(1, 16) / 16)
    assert ranker.edges[0] == pytest.approx(want, rel=1e-2)
    rows = quality_rank.measured(docs.limit(50))
    same = [{r.doc_id: r.score for r in quality_rank.scored(x, ranker).collect()} for x in (docs, rows)]
    assert all(same[0][k] == v for k, v in same[1].items()) and len(same[1]) == 50
    # counted rows are fitted as rows written out are
    rng = np.random.default_rng(4)
    bins, label, many = rng.integers(0, 16, (40, 14)).astype(np.uint8), rng.integers(0, 2, 40), rng.integers(1, 4, 40)
    one = quality_rank.fit_bins(ranker.edges, bins, label, many.astype(float))
    two = quality_rank.fit_bins(ranker.edges, np.repeat(bins, many, axis=0), np.repeat(label, many), np.ones(many.sum()))
    assert one.weights == pytest.approx(two.weights, abs=1e-4) and one.zero == pytest.approx(two.zero, abs=1e-3) and one.base == two.base


def plain_buckets(text):
    """Buckets of the 1- to 3-grams of a lowered text with three spaces in front, each by hand."""
    out, padded = [], [*(" " * 3 + text.lower()), " ", " ", " "]
    for i in range(len(padded) - 3):
        key = 0
        for c in padded[i:i + 3]:
            key = ((key ^ ord(c)) * 0x9E3779B1) % 2**32
            key ^= key >> 15
            out.append(((key * 0x85EBCA6B) % 2**32) >> 16)
    return out


def test_languages_against_brute_force(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, lang, rng.randint(1, 40)), lang) for i, lang in enumerate(["de", "en", "es", "fr"] * 20)] + [(900, "²½ ① Ⅷ 12", "de"), (901, "", "en"), (902, None, "en"), (903, "ⅷ", None), (904, "ª", None), (905, "漢", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs = ["de", "en", "es", "fr"]
    counts = np.full((4, language_id.BUCKETS), 0.5)
    for i, t, lang in rows:
        if lang and t is not None and i % 5:
            np.add.at(counts[langs.index(lang)], plain_buckets(t), 1)
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    got = {r.doc_id: r for r in language_id.identified(df, F.col("doc_id") % 5 != 0).collect()}
    for i, t, _ in rows:
        if not t or not re.search(r"[a-zA-Zäöüßéèêñáíóúçàâîôûœª漢]", t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0), t
            continue
        each = logs[:, plain_buckets(t)].sum(axis=1)
        assert got[i].lang_pred == langs[int(each.argmax())] and got[i].score == pytest.approx(1 / np.exp(each - each.max()).sum(), rel=1e-3)


def test_learning_from_many_rows_of_one_id(spark):
    """Rows share a doc_id that the sample's hash doesn't draw: all of them are learned from."""
    for i in range(20):
        df = spark.createDataFrame([(i, f"der hund und die katze {k}", "de") for k in range(40)], "doc_id long, text string, lang string")
        langs, _ = language_id.fit(df, F.lit(True), fit_docs=1)
        assert langs == ["de"]
        if i > 2:
            break


def test_languages(spark, hard, empty):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, 40), lang) for i, lang in enumerate(["de", "en", "es", "fr"] * 60)] + [(1000, "nolang here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identified(df, F.col("doc_id") % 5 != 0).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if lang and i % 5 == 0]) > 0.9
    langs, matrix = language_id.fit(df, F.lit(True))
    found = language_id.predicted(hard, langs, matrix).collect()
    assert len(found) == hard.count() and Counter(r.lang_pred == "und" for r in found)[True] == 5 and all(0 <= r.score <= 1 for r in found)
    assert language_id.predicted(empty, langs, matrix).count() == 0
    assert {r.lang_pred for r in language_id.identified(hard, F.lit(True)).collect()} == {"und"}


def test_language_scores_do_not_depend_on_the_batch():
    texts = ["Der Hund", "a", "le chat est là", "漢字"]
    one = [np.concatenate([b for _, b, _ in language_id.ngram_buckets([t])]).tolist() for t in texts]
    found = [[] for _ in texts]
    for a, buckets, starts in language_id.ngram_buckets(texts):
        for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(buckets)])):
            found[a + k] += buckets[s:e].tolist()
    assert found == one


SECRETS = st.text("AKIA0Z9abcdef tokensecrtpwi_:='\"\n İſK.=-", max_size=80)


def plain_spans(text):
    """Base spans by trying every start of each kind, without the automaton or the operator's expressions."""
    word = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
    lowered = "".join(c.lower() if c.isascii() else c for c in text)

    def run(at, allowed):
        while at < len(text) and text[at] in allowed:
            at += 1
        return at

    def assign(at):
        """Where an assignment that begins here ends, and its value's length; None without one."""
        for key in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lowered.startswith(key, at):
                p = at + len(key)
                for quoted in ((p + 1, p) if text[p:p + 1] in ("'", '"') and p < len(text) else (p,)):
                    q = run(quoted, " ")
                    if text[q:q + 1] in (":", "=") and q < len(text):
                        q = run(q + 1, " ")
                        q += text[q:q + 1] in ("'", '"') and q < len(text)
                        end = run(q, word)
                        if end > q:
                            return end, end - q
        return None

    found, at = [], 0
    while at < len(text):
        hit = assign(at)
        if hit and hit[1] >= 6:
            found.append(("assign", at, hit[0]))
        at = hit[0] if hit else at + 1
    at = 0
    while at < len(text):
        end = run(at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) if text.startswith("AKIA", at) else at
        if end > at + 4:
            if end - at >= 20:
                found.append(("access", at, end))
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run(at, set("0123456789abcdef"))
        if end - at >= 24:
            found.append(("hex", at, end))
        at = max(end, at + 1)
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.one_of(SECRETS, st.sampled_from(["token = ", "api_key=", "APIKEY: '", "passwd:", 'Secret" = "', "AKIA" + "X" * 16, "AKIAAKIA" + "0" * 15, "f" * 24, "secret", "password = hunter2x", "token=token=abcdefg", "ghp_", "x" * 6])), max_size=8))
def test_secrets_against_brute_force(parts):
    text = "".join(parts)
    assert [x for x in secret_scan.spans(text) if x[0] in secret_scan.BASE] == plain_spans(text)


def test_digests_of_secrets(spark):
    import hashlib

    texts = ["é token=abcdefgh and AKIA" + "A" * 16, "0" * 30 + " password: 'xyzxyz1'", "none"]
    rows = secret_scan.digested(secret_scan.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(t))
        assert r.spans == said and r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in plain_spans(t)) for k in ("assign", "access", "hex"))


def test_checksums_and_masks():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"ghp_{body}{secret_scan.checksum(body)}"
    assert secret_scan.spans(f"x {good} y") == [("github", 2, 42)]
    assert secret_scan.spans(f"x {good[:-1]}{'0' if good[-1] != '0' else '1'} y") == []
    assert secret_scan.masked(f"é token={good} end") == f"é {secret_scan.MASK} end"
    assert secret_scan.masked(None) is None and secret_scan.masked("plain") == "plain"


def test_secret_scan_of_hard_rows(hard, empty):
    got = secret_scan.digested(secret_scan.scanned(hard)).collect()
    assert len(got) == hard.count() and all(r.spans == "" for r in got)
    assert secret_scan.scanned(empty).count() == 0
    out = secret_scan.redacted(hard)
    assert out.columns == hard.columns and out.count() == hard.count()


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def overlaps(docs, items, least):
    found = {}
    for d, t in docs:
        x = tokens(t)
        for i, b in items:
            b = tokens(b)
            if b:
                best = max((sum(0 <= s + k < len(x) and x[s + k] == w for k, w in enumerate(b)) for s in range(-len(b), len(x))), default=0)
                if best >= least * len(b):
                    found[d, i] = max(best, found.get((d, i), 0))
    return found


def test_decontamination(spark, hard, empty):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 40, 20, 15, 5, 1])] + [(6, None), (7, ""), (8, "   ")]
    docs = []
    for d in range(60):
        body = text(80).split()
        i, b = items[d % 4]
        b = b.split()
        for k in rng.sample(range(len(b)), d % 5):  # up to four substitutions
            b[k] = "changed"
        docs.append((d, " ".join(body[:40] + (b if d % 3 else []) + body[40:])))
    docs += [(60, items[4][1]), (61, items[5][1]), (62, "x " + items[0][1] + " y " + items[0][1])]
    df = spark.createDataFrame(docs + docs[:1], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontamination.overlaps(df, bench).collect()}
    want = overlaps(docs, items, decontamination.OVERLAP)
    exact = {k for k, m in want.items() if m == len(tokens(items[k[1]][1]))}
    assert all(want.get(k) == m for k, m in got.items()) and exact <= set(got)
    assert len(got) >= 0.95 * len(want)  # seeds tolerate substitutions, but a scattered few can hide an overlap
    assert decontamination.clean(df, bench).filter(F.col("doc_id").isin([d for d, i in got if len(tokens(items[i][1])) >= decontamination.LEAST_ITEM])).count() == 0
    assert decontamination.clean(hard, bench).columns == hard.columns
    assert decontamination.overlaps(hard, bench).count() == 0 and decontamination.overlaps(empty, bench).count() == 0 and decontamination.overlaps(df, bench.limit(0)).count() == 0


def test_a_benchmark_in_blocks(spark, monkeypatch):
    items = [(i, " ".join(f"q{i}x{k}" for k in range(20))) for i in range(12)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4_000)
    parts = decontamination.blocks_of(*decontamination._items(bench, decontamination.MASKS, decontamination.OVERLAP, 1))
    keys = [({r[0] for r in own.select("_tm_key").collect()}, {r[0] for r in seeded.select("_tm_key").distinct().collect()}) for own, seeded in parts]
    assert len(parts) > 3 and all(a == b for a, b in keys) and sum(len(a) for a, _ in keys) == 12
    assert sorted((r.doc_id, r.item_id, r.start) for r in decontamination.overlaps(docs, bench).collect()) == [(i, i, 1) for i in range(12)]


def test_places_are_verified_once_and_short_items_bring_none_of_others(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    long = " ".join(rng.choice(words) for _ in range(200))
    docs = spark.createDataFrame([(d, " ".join(rng.choice(words) for _ in range(300)) + " " + long) for d in range(20)], "doc_id long, text string")

    def verified(items):
        items, serves = decontamination._items(spark.createDataFrame(items, "item_id long, text string"), decontamination.MASKS, decontamination.OVERLAP, 1)
        ((own, seeded),) = decontamination.blocks_of(items, serves)
        found = decontamination.places(docs, seeded, list(serves)).join(own, "_tm_key")
        assert found.count() == found.select("doc_id", "item_id", "_tm_start").distinct().count()
        return Counter(r.item_id for r in found.collect())

    alone, both = verified([(0, long)]), verified([(0, long), (1, "w7")])
    assert both[0] == alone[0] and both[1] > 0
    item = spark.createDataFrame([(1, "w7")], "item_id long, text string")
    assert decontamination.overlaps(docs, item).count() == 20 and decontamination.clean(docs, item).count() == 20


def test_clean_drops_parts_of_items(spark):
    item, own = [f"q{k}" for k in range(59)], [f"o{k}" for k in range(60)]
    texts = [own, own + item[:45] + own, own + item[:30] + ["more"] + item[30:] + own, own + item[:30] + item[31:], own + item[:12] + own, own + item[20:29] + ["x"] + item[30:38]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [0, 4]
    assert decontamination.overlaps(docs, bench).count() == 0


def test_short_items_are_found_with_all_substitutions(spark):
    from itertools import combinations

    items, docs = [], []
    for n in range(1, 15):
        words = [f"n{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for gone in range(n - -(-4 * n // 5) + 1):
            for at in combinations(range(n), gone):
                text = " ".join("other" if k in at else w for k, w in enumerate(words))
                docs += [(len(docs), "before " + text + " after"), (len(docs) + 1, text)]
        cut = n - -(-4 * n // 5)
        docs += [(len(docs), " ".join(words[cut:])), (len(docs) + 1, " ".join(words[:n - cut]))]
    found = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.matched for r in found.collect()} == overlaps(docs, items, decontamination.OVERLAP)


def test_clean_goes_by_row(spark):
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(None, item), (None, "clean"), (None, None), (4, "a " + item), (4, "clean too"), (5, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert Counter(map(tuple, decontamination.clean(docs, bench).collect())) == Counter([rows[1], rows[2], rows[4], rows[5]])


@pytest.mark.parametrize("mask", decontamination.MASKS)
def test_masks_ignore_a_position(mask):
    assert mask[0] == mask[-1] == "1" and "0" in mask
