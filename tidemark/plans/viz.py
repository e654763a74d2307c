"""A graph as DOT or Mermaid, without running it."""

from __future__ import annotations

from ..model import Node
from .run import build


def topology(graph, *args, **kwargs) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    """Nodes (number, op), inputs first, and edges between them; outputs are nodes too."""
    made = build(graph, *args, **kwargs)
    nodes, edges, number = [], [], {}

    def visit(n: Node) -> int:
        if n.id not in number:
            inputs = [visit(i) for i in n.inputs]
            number[n.id] = len(nodes)
            nodes.append((len(nodes), n.op))
            edges.extend((i, number[n.id]) for i in dict.fromkeys(inputs))
        return number[n.id]

    for s in made.series:
        visit(s.node)
    for name, xs in made.outputs.items():
        at = len(nodes)
        nodes.append((at, f"output {name}"))
        edges.extend((visit(x.node), at) for x in xs)
    return nodes, edges


def graph_to_dot(graph, *args, **kwargs) -> str:
    nodes, edges = topology(graph, *args, **kwargs)
    quoted = [op.replace('"', '\\"') for _, op in nodes]
    return "\n".join(["digraph {", "  rankdir=LR;", *(f'  n{i} [label="{op}"];' for i, op in enumerate(quoted)), *(f"  n{a} -> n{b};" for a, b in edges), "}"])


def graph_to_mermaid(graph, *args, **kwargs) -> str:
    nodes, edges = topology(graph, *args, **kwargs)
    return "\n".join(["graph LR", *(f'  n{i}["{op}"]' for i, op in nodes), *(f"  n{a} --> n{b}" for a, b in edges)])


def show_graph(graph, *args, filename: str, **kwargs) -> str:
    """Writes DOT, or Mermaid where the name ends in .mmd, and returns the name."""
    text = graph_to_mermaid(graph, *args, **kwargs) if filename.endswith(".mmd") else graph_to_dot(graph, *args, **kwargs)
    name = filename if filename.endswith((".dot", ".mmd")) else filename.rsplit(".", 1)[0] + ".dot"
    with open(name, "w") as f:
        f.write(text)
    return name
