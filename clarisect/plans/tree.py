"""The explaining tree: a small table of nodes, and the expressions, texts and statistics made from it."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Children of node i are 2i + 1 and 2i + 2, in 64 bits.
MAX_DEPTH = 61
SCHEMA = (
    "node_id long, parent_id long, depth int, feature int, feature_name string, bin int, threshold double, is_leaf boolean, is_terminal boolean, "
    "cluster_ids array<int>, leaf_cluster int, samples long, mistakes long, residual_samples long, scored_mistakes long"
)


@dataclass
class Node:
    node_id: int
    parent_id: int | None = None
    depth: int = 0
    feature: int | None = None
    feature_name: str | None = None
    bin: int | None = None
    threshold: float | None = None
    is_leaf: bool = False
    is_terminal: bool = True
    cluster_ids: list[int] = field(default_factory=list)
    leaf_cluster: int | None = None
    samples: int | None = None
    mistakes: int | None = None
    residual_samples: int | None = None
    scored_mistakes: int | None = None


class Tree:
    """Nodes by id; inner nodes have a feature and a threshold, leaves name a cluster."""

    def __init__(self, nodes: Sequence[Node]):
        self.nodes = {n.node_id: n for n in nodes}

    # ---- shape

    def children(self, node: Node) -> list[Node]:
        return [self.nodes[i] for i in (2 * node.node_id + 1, 2 * node.node_id + 2) if node.feature is not None and i in self.nodes]

    def ordered(self) -> list[Node]:
        return [self.nodes[i] for i in sorted(self.nodes)]

    def leaves(self) -> list[Node]:
        return [n for n in self.ordered() if n.feature is None]

    @property
    def size(self) -> int:
        return len(self.nodes)

    @property
    def depth(self) -> int:
        """Depth of the deepest node; an empty tree has -1."""
        return max((n.depth for n in self.nodes.values()), default=-1)

    def split(self, node_id: int, feature: int, threshold: float | None, bin: int | None = None, scored: int | None = None) -> tuple[Node, Node]:
        """Gives a node a cut and two new children."""
        node = self.nodes[node_id]
        if node.depth >= MAX_DEPTH:
            raise ValueError(f"node {node_id} is too deep to be split")
        node.feature, node.threshold, node.bin, node.scored_mistakes = feature, threshold, bin, scored
        node.is_leaf = node.is_terminal = False
        made = tuple(Node(2 * node_id + k, node_id, node.depth + 1) for k in (1, 2))
        self.nodes.update({n.node_id: n for n in made})
        return made

    # ---- as expressions

    def route(self, left: Callable[[Node], Column]) -> Column:
        """The id of the terminal node a row reaches; ``left`` is the test that sends a row left."""
        def at(i: int) -> Column:
            node = self.nodes[i]
            if node.feature is None:
                return F.lit(i).cast("long")
            return F.when(left(node), at(2 * i + 1)).otherwise(at(2 * i + 2))

        return at(0)

    def route_strict(self, left: Callable[[Node], Column], own_left: Callable[[Node], list[int]], label: str = "cluster_id") -> Column:
        """(node_id, is_valid): a row stops at the child where it parts from its own center."""
        def at(i: int) -> Column:
            node = self.nodes[i]
            if node.feature is None:
                return F.struct(F.lit(i).cast("long").alias("node_id"), F.lit(True).alias("is_valid"))

            def child(k: int, same: Column) -> Column:
                stop = F.struct(F.lit(2 * i + k).cast("long").alias("node_id"), F.lit(False).alias("is_valid"))
                return F.when(same, at(2 * i + k)).otherwise(stop)

            mine = F.col(label).isin(own_left(node)) if own_left(node) else F.lit(False)
            return F.when(left(node), child(1, mine)).otherwise(child(2, ~mine))

        return at(0)

    @staticmethod
    def by_threshold(column: str = "features") -> Callable[[Node], Column]:
        return lambda node: F.col(column)[node.feature] <= F.lit(float(node.threshold))

    def leaf(self, column: str = "features") -> Column:
        return self.route(self.by_threshold(column))

    def label(self, column: str = "features") -> Column:
        """The cluster a row's leaf names, as one nested CASE inside code generation."""
        def at(i: int) -> Column:
            node = self.nodes[i]
            if node.feature is None:
                return F.lit(node.leaf_cluster).cast("int")
            return F.when(self.by_threshold(column)(node), at(2 * i + 1)).otherwise(at(2 * i + 2))

        return at(0)

    # ---- as tables and texts

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(n).values()) for n in self.ordered()], SCHEMA)

    @classmethod
    def from_table(cls, df: DataFrame) -> Tree:
        return cls([Node(**r.asDict()) for r in df.collect()])

    def to_json(self) -> str:
        """Nested objects with the cut or the cluster, the counts, and both children."""
        def at(i: int) -> dict:
            n = self.nodes[i]
            kids = [at(c.node_id) for c in self.children(n)]
            value = n.threshold if n.feature is not None else n.leaf_cluster
            return {"feature": n.feature, "value": value, "samples": n.samples, "mistakes": n.mistakes, "left": kids[0] if kids else None, "right": kids[1] if kids else None}

        return json.dumps(at(0) if self.nodes else None)

    @classmethod
    def from_json(cls, text: str) -> Tree:
        nodes: list[Node] = []

        def at(d: dict, i: int, depth: int) -> None:
            inner = d["feature"] is not None
            nodes.append(Node(i, (i - 1) // 2 if i else None, depth, d["feature"], None, None, d["value"] if inner else None, not inner, not inner, [] if inner else [d["value"]], None if inner else d["value"], d["samples"], d["mistakes"]))
            if inner:
                at(d["left"], 2 * i + 1, depth + 1)
                at(d["right"], 2 * i + 2, depth + 1)

        if (root := json.loads(text)) is not None:
            at(root, 0, 0)
        return cls(nodes)

    def cut_text(self, node: Node, splits: Sequence[Sequence[float]] | None = None) -> str:
        """A node's test with its real threshold; a bin that the splits do not hold stays a bin."""
        if node.feature is None:
            return "No split"
        if node.threshold is not None:
            return f"(f{node.feature} <= {node.threshold:.3f})"
        if splits is not None and node.feature < len(splits) and node.bin < len(splits[node.feature]):
            return f"(f{node.feature} <= {splits[node.feature][node.bin]:.3f})"
        return f"(f{node.feature} <= [bin {node.bin}])"

    def lines(self, splits: Sequence[Sequence[float]] | None = None) -> list[str]:
        """One line per node, by id."""
        def known(v: int | None) -> str:
            return "?" if v is None else str(v)

        return [
            f"Node {n.node_id}: {'Leaf' if n.is_leaf else f'Node {n.node_id}'} | depth={n.depth} | split={self.cut_text(n, splits)} | "
            f"clusters=[{','.join(map(str, n.cluster_ids))}] | samples={known(n.samples)} | mistakes={known(n.mistakes)}"
            for n in self.ordered()
        ]

    def to_dot(self, names: Sequence[str] | None = None, inner_mistakes: bool = False) -> str:
        """A Graphviz digraph, nodes numbered breadth first."""
        number = {n.node_id: k for k, n in enumerate(self.ordered())}
        boxes, arrows = [], []
        for n in self.ordered():
            inner = n.feature is not None
            title = f"{names[n.feature] if names else n.feature} <= {n.threshold:.3f}" if inner else str(n.leaf_cluster)
            parts = [title, f"samples={n.samples}"] + ([f"mistakes={n.mistakes}"] if not inner or inner_mistakes else [])
            boxes.append(f'n_{number[n.node_id]} [label="' + "\\n".join(parts) + '"];')
            arrows += [f"n_{number[n.node_id]} -> n_{number[c.node_id]};" for c in self.children(n)]
        return "\n".join(["digraph ClusteringTree {", *boxes, *arrows, "}"])

    # ---- statistics

    def fill_stats(self, df: DataFrame, label: str = "prediction", column: str = "features") -> Tree:
        """Rows and mistakes of every node from one pass over the data; inner nodes sum up their leaves."""
        own = F.col(label)
        wanted = self.label(column)
        counts = {r["leaf"]: (r["n"], r["m"]) for r in df.select(self.leaf(column).alias("leaf"), (own != wanted).alias("wrong")).groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("wrong").alias("m")).collect()}
        for n in reversed(self.ordered()):
            kids = self.children(n)
            n.samples, n.mistakes = (sum(c.samples for c in kids), sum(c.mistakes for c in kids)) if kids else counts.get(n.node_id, (0, 0))
        return self

    def feature_importance(self, features: int) -> list[int]:
        """How many inner nodes test each feature."""
        out = [0] * features
        for n in self.nodes.values():
            if n.feature is not None:
                out[n.feature] += 1
        return out
