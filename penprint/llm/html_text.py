"""Main text of web pages: gradient-boosted trees over DOM nodes, with hierarchical decoding.

Every block node gets features of its subtree's density, attribute words, depth and siblings
(``dom.features``). Spark's gradient-boosted trees are fitted on a bounded sample: at most
``SAMPLE_PAGES`` pages by the order of a hash of their id, each as given and in ``SKINS`` other layouts
(``skins``). Pages of more than ``SAMPLE_CHARS`` characters come after all others, shorter ones first, and
only until the sample holds ``SAMPLE_PAGES * SAMPLE_CHARS`` characters. Decoding picks the likeliest set of nodes in which
nothing is kept below a dropped node. All pages are read whole, page by page.

Defined results: null, empty and text-free pages give the empty string; null or repeated ``page_id`` are
rows like any others; the text is taken from the page as it stands, truncated or malformed; a table
without any content to learn from gives empty strings; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penprint.llm import dom, skins
from penprint.llm.common import saved, table

SAMPLE_PAGES, SAMPLE_CHARS, SKINS = 200, 50_000, 6
TREES, DEPTH = 20, 5


class Trees:
    """Fitted trees as arrays, so that tasks can score many nodes at once without the JVM."""

    def __init__(self, model):
        self.weights = np.array(model.treeWeights)
        self.trees = [self._flat(t._call_java("rootNode")) for t in model.trees]

    @staticmethod
    def _flat(root) -> tuple[np.ndarray, ...]:
        rows, todo = [], [(root, -1, 0)]
        while todo:
            node, parent, side = todo.pop()
            at = len(rows)
            leaf = node.getClass().getSimpleName() == "LeafNode"
            split = None if leaf else node.split()
            rows.append([0 if leaf else split.featureIndex(), 0.0 if leaf else split.threshold(), at, at, node.prediction()])
            if parent >= 0:
                rows[parent][2 + side] = at
            if not leaf:
                todo += [(node.leftChild(), at, 0), (node.rightChild(), at, 1)]
        return tuple(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (int, float, int, int, float), strict=True))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for weight, (feature, threshold, left, right, value) in zip(self.weights, self.trees, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = np.where(x[np.arange(len(x)), feature[at]] <= threshold[at], left[at], right[at])
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def training_rows(pages: DataFrame) -> DataFrame:
    """``features, label`` of the nodes of the sampled pages in all their layouts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed, source in zip(batch.column("seed").to_pylist(), batch.column("html").to_pylist(), strict=True):
                rows, truth = [], []
                for source_of_one in [skins.given(source), *(skins.render(source, seed * 31 + k) for k in range(SKINS))]:
                    if source_of_one and "data-keep='1'" in source_of_one:
                        page = dom.parse(source_of_one)
                        rows += dom.features(page)
                        truth += dom.labels(page)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.list_(pa.float64())), pa.array(truth, pa.float64())], ["features", "label"]
                )

    longer = F.greatest(F.ceil(F.log2(F.length("html") / SAMPLE_CHARS)), F.lit(0))
    first = (
        pages.where(F.col("html").isNotNull())
        .select(longer.alias("longer"), F.xxhash64("page_id", "html").alias("seed"), "html")
        .orderBy("longer", "seed")
        .limit(SAMPLE_PAGES)
    )
    before = Window.orderBy("longer", "seed").rowsBetween(Window.unboundedPreceding, -1)
    sample = (
        first.withColumn("before", F.coalesce(F.sum(F.length("html")).over(before), F.lit(0)))
        .where(F.col("before") < SAMPLE_PAGES * SAMPLE_CHARS)
        .select("seed", "html")
    )
    return saved(sample.mapInArrow(work, "features array<double>, label double"), "page-nodes")


def fit(pages: DataFrame) -> Trees | None:
    rows = training_rows(pages)
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = rows.select(array_to_vector("features").alias("features"), "label").coalesce(2)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, featureSubsetStrategy="all").fit(vectors)
    return Trees(model)


def main_text(pages: DataFrame, trees: Trees | None) -> DataFrame:
    """``page_id, url, text`` of every row of ``page_id``, ``url`` and ``html``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                parsed = [dom.parse(source or "") for source in part.column("html").to_pylist()]
                rows = [dom.features(page) for page in parsed]
                ends = np.cumsum([len(r) for r in rows])
                flat = np.array([r for some in rows for r in some]).reshape(-1, len(dom.NAMES))
                scores = np.zeros(len(flat)) if trees is None else trees.probabilities(flat)
                texts = []
                for page, end, some in zip(parsed, ends, rows, strict=True):
                    kept = dom.decide(page, scores[end - len(some) : end])
                    texts.append(dom.text_of(page, kept) if trees is not None else "")
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
                )

    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"page_id {kind}, url string, text string")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
