"""Main text of pages: gradient-boosted trees over block features, decoded over the tree of blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import stored, text_of
from .dom import NAMES, Node, Page, features
from .page_samples import KEEP, page

#: Made-up pages the model is fitted on; no row of the input is.
FIT_PAGES = 1_500
TREES, DEPTH = 12, 5
#: Pages whose blocks are scored at once.
TOGETHER = 200


class Marked(Page):
    """A made-up page, with the mark of each block."""

    def __init__(self, html: str):
        self.marks: dict[int, str] = {}
        super().__init__(html)

    def _begin(self, tag: str, attrs) -> None:
        super()._begin(tag, attrs)
        for k, v in attrs:
            if k == "data-m":
                self.marks[len(self.nodes) - 1] = v

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "body" and ("data-m", KEEP) in attrs:
            self.marks[0] = KEEP
        super().handle_starttag(tag, attrs)

    def shares(self) -> np.ndarray:
        """Per node the share of its text that is to be kept."""
        state: list[str | None] = []
        kept, chars = np.zeros(len(self.nodes)), np.zeros(len(self.nodes))
        for i, node in enumerate(self.nodes):
            state.append(self.marks.get(i, state[node.parent] if i else None))
            if node.text:
                chars[i] = sum(map(len, node.text))
                kept[i] = chars[i] * (state[i] == KEEP)
        for i in range(len(self.nodes) - 1, 0, -1):
            kept[self.nodes[i].parent] += kept[i]
            chars[self.nodes[i].parent] += chars[i]
        return np.where(chars > 0, kept / np.maximum(chars, 1), -1.0)


@dataclass(frozen=True)
class Boosted:
    """Fitted trees as arrays: in each row of a tree a feature and a threshold, or -1 and a value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                go_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(go_left, self.left[at], self.right[at]))
            margin += weight * self.value[at]
        return 1 / (1 + np.exp(-2 * margin))


def exported(model) -> Boosted:
    """The trees of a fitted Spark model as arrays, so that tasks score blocks where the pages are."""
    rows: list[list[float]] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        if hasattr(node, "subtreeDepth") and node.subtreeDepth() > 0:
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2], rows[at][3] = walk(node.leftChild()), walk(node.rightChild())
        return at

    roots = [walk(tree._call_java("rootNode")) for tree in model.trees]
    a = np.array(rows, float)
    return Boosted(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), np.array(model.treeWeights))


_FITTED: dict[str, tuple[Boosted, Boosted]] = {}


def fit(spark: SparkSession, pages: int = FIT_PAGES) -> tuple[Boosted, Boosted]:
    """Two classifiers of blocks: whether most text is to be kept, and whether a block is mixed.

    Spark makes the sample pages in tasks and fits the trees; their number is fixed, so the cost doesn't grow with the
    input. The model is kept for the application.
    """
    key = f"{spark.sparkContext.applicationId} {pages}"
    if key in _FITTED:
        return _FITTED[key]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed in batch["id"]:
                made = Marked(page(int(seed)))
                share = made.shares()
                told = share >= 0
                x = features(made.nodes)[told]
                yield pd.DataFrame({"x": list(x), "keep": (share[told] > 0.5).astype(float), "mixed": ((share > 0) & (share < 1))[told].astype(float)})

    rows = spark.range(0, pages, 1, 8).mapInPandas(make, "x array<float>, keep double, mixed double")
    rows = stored(rows, "blocks").select(array_to_vector("x").alias("x"), "keep", "mixed").persist()
    trees = lambda label, part: exported(GBTClassifier(featuresCol="x", labelCol=label, maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(part))
    _FITTED.clear()
    _FITTED[key] = trees("keep", rows.filter("mixed = 0")), trees("mixed", rows)
    rows.unpersist()
    return _FITTED[key]


def decoded(nodes: list[Node], keep: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the most probable labelling of the tree without contradictions.

    A node is kept whole, dropped whole, or mixed. All below a kept node is kept and all below a dropped one dropped;
    only below mixed nodes are nodes free. Best scores are summed from the leaves up, then choices made from the root.
    """
    keep, mixed = np.clip(keep, 0.002, 0.998), np.clip(mixed, 0.002, 0.998)
    leaf = np.array([not n.children for n in nodes])
    whole = np.where(leaf, 0.0, np.log(1 - mixed))
    kept, dropped = (whole + np.log(keep)).tolist(), (whole + np.log(1 - keep)).tolist()
    free = np.where(leaf, -np.inf, np.log(mixed)).tolist()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        kept[p] += kept[i]
        dropped[p] += dropped[i]
        free[p] += max(kept[i], dropped[i], free[i])
    label: list[str] = []
    for i, node in enumerate(nodes):
        above = label[node.parent] if i else "free"
        label.append(above if above != "free" else "kept" if kept[i] >= max(dropped[i], free[i]) else "dropped" if dropped[i] >= free[i] else "free")
    return np.array([x == "kept" for x in label])


def blocks_of(nodes: list[Node], kept: np.ndarray) -> str:
    """Texts of kept blocks in page order, white space in each as single spaces, one block a line."""
    lines = (" ".join("".join(n.text).split()) for n, k in zip(nodes, kept) if k and n.text)
    return "\n".join(line for line in lines if line)


def main_text(pages: DataFrame, model: tuple[Boosted, Boosted] | None = None, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Main text of each page from its whole html, in one pass where the rows lie.

    Null and empty pages, and pages without an article, have an empty text; repeated rows are read each; very long or
    deep pages take time in proportion to their size; where keeping and dropping are equally likely (ties), a block is
    kept. All columns of pages but the html stay, so a column `text` among them would clash and is replaced; an empty
    table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages.sparkSession))

    @F.pandas_udf("string")
    def extract(htmls: pd.Series) -> pd.Series:
        out: list[str] = []
        for begin in range(0, len(htmls), TOGETHER):
            trees = [Page(h).nodes for h in htmls.iloc[begin : begin + TOGETHER]]
            every = np.concatenate([features(nodes) for nodes in trees])
            keep, mixed = (m.probability(every) for m in shared.value)
            at = 0
            for nodes in trees:
                part = slice(at, at + len(nodes))
                out.append(blocks_of(nodes, decoded(nodes, keep[part], mixed[part])))
                at += len(nodes)
        return pd.Series(out, dtype=object)

    rest = [pages[c] for c in pages.columns if c not in (html_column, "text")]
    return pages.select(*rest, extract(text_of(pages, html_column)).alias("text"))
