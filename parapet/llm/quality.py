"""Document quality by hierarchical empirical Bayes.

A linear classifier on the shape of a text gives evidence for each document. Its expected positives are summed by site
and by path below the site. Site rates are shrunk towards the global rate, path rates towards their site's, each with a
prior strength estimated from the spread between groups (method of moments), so that groups with few documents say
little. A document's posterior adds the log odds of its evidence and of how far its path departs from the global rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parapet.llm import linear
from parapet.llm.common import buffers, one_text, slices, written

ROWS_PER_SIDE = 3_000
RIDGE = 1.0
THRESHOLD = 0.5
CHUNK = 16 << 20
#: Kinds of bytes: lower, upper, digit, blank, line end, common punctuation, other ASCII symbols, bytes above ASCII.
KINDS = 8


def _table() -> np.ndarray:
    kind = np.full(256, 7, np.uint8)
    kind[:128] = 6
    kind[ord("a"):ord("z") + 1] = 0
    kind[ord("A"):ord("Z") + 1] = 1
    kind[ord("0"):ord("9") + 1] = 2
    kind[[9, 32]] = 3
    kind[[10, 13]] = 4
    kind[[ord(c) for c in ".,;:'\"()-"]] = 5
    return kind


def features(column: pa.Array) -> np.ndarray:
    """Shares of the kinds of bytes, words per byte and the logarithm of the size; zeros for empty texts."""
    offsets, data = buffers(column)
    table = _table()
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = np.zeros((n, KINDS))
    for i in range(n):
        counts[i] = np.bincount(table[data[offsets[i]:offsets[i + 1]]], minlength=KINDS)
    share = counts / np.maximum(sizes, 1)[:, None]
    return np.column_stack([share, (counts[:, 3] + counts[:, 4]) / np.maximum(sizes, 1), np.log1p(sizes) / 10])


@dataclass
class Evidence:
    """The classifier: scale of the features and weights."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return linear.predict(self.weights, (x - self.centre) / self.spread)


def _featured(docs: DataFrame, text: str) -> DataFrame:
    others = [c for c in docs.columns if c != text]

    def run(batches):
        for batch in slices(batches, "text", CHUNK):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.array(list(x), pa.list_(pa.float64()))], others + ["x"])

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in others) + ", x array<double>"
    return docs.select(*others, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, rows_per_side: int = ROWS_PER_SIDE, doc_id: str = "doc_id",
        text: str = "text", good: str = "quality") -> Evidence:
    """Fit the classifier on at most ``rows_per_side`` labelled documents of either side, the lowest by hash of the id."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(good).cast("int").alias("y")).dropna()
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    sides = [known.filter(F.col("y") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_side)
             for side in (0, 1)]
    ids = sides[0].unionByName(sides[1])
    rows = one_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(ids, "doc_id"))
    got = _featured(rows, "text").orderBy("doc_id", "x").collect()
    x = np.array([row["x"] for row in got]).reshape(len(got), KINDS + 2)
    y = np.array([row["y"] for row in got], np.float64)
    if not len(got):
        return Evidence(np.zeros(KINDS + 2), np.ones(KINDS + 2), np.zeros(KINDS + 3))
    centre, spread = x.mean(0), x.std(0) + 1e-6
    return Evidence(centre, spread, linear.fit((x - centre) / spread, y, RIDGE))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength in documents, from how much group rates differ more than their sizes explain."""
    rate, n = F.col("good") / F.col("n"), F.col("n")
    row = groups.select(n.alias("n"), (n * F.pow(rate - mean, F.lit(2.0))).alias("d"), (mean * (1 - mean)).alias("v")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("k"),
        F.sum("d").alias("d"), F.avg("v").alias("v")).first()
    if not row["n"] or row["k"] < 2 or not row["v"]:
        return 1.0
    size = row["n"] - row["nn"] / row["n"]
    between = max((row["d"] - row["k"] * row["v"]) / size, 0.0) if size > 0 else 0.0
    return min(max(row["v"] / between - 1, 1.0), 1e6) if between > 0 else 1e6


def shrunk(scored: DataFrame) -> tuple[float, DataFrame]:
    """The global rate, and one row per path: ``site, path, n_path, n_site, site_rate, path_rate``.

    ``scored`` has ``site, path, p``. Groups of any size are summed before they are shuffled.
    """
    paths = written(scored.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")), "paths")
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = sites.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = (total["good"] / total["n"]) if total["n"] else 0.5
    k = _strength(sites, F.lit(overall))
    site_rate = (F.col("good") + F.lit(k * overall)) / (F.col("n") + F.lit(k))
    sites = sites.select("site", F.col("n").alias("n_site"), site_rate.alias("site_rate"))
    below = paths.join(sites, "site")
    k = _strength(below, F.col("site_rate"))
    path_rate = (F.col("good") + F.lit(k) * F.col("site_rate")) / (F.col("n") + F.lit(k))
    return overall, below.select("site", "path", F.col("n").alias("n_path"), "n_site", "site_rate",
                                 path_rate.alias("path_rate"))


def posterior(docs: DataFrame, evidence: Evidence, site: Column, path: Column, doc_id: str = "doc_id",
              text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, site, path, p_document, site_rate, path_rate, p_good, keep``.

    Null sites and paths are groups of their own (empty strings); null and empty texts have the evidence of an empty text.
    Rows with equal or null ids are judged each for itself.
    """
    def run(batches):
        for batch in slices(batches, "text", CHUNK):
            p = evidence.predict(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "site", "path")] + [pa.array(p)],
                                             ["doc_id", "site", "path", "p"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(site.cast("string"), F.lit("")).alias("site"),
                       F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    scored = written(rows.mapInArrow(run, f"doc_id {kind}, site string, path string, p double"), "evidence")
    overall, groups = shrunk(scored)
    joined = scored.join(groups, ["site", "path"])
    odds = logit(F.col("p")) + logit(F.col("path_rate")) - logit(F.lit(overall))
    p_good = 1 / (1 + F.exp(-odds))
    return joined.select("doc_id", "site", "path", F.col("p").alias("p_document"), "site_rate", "path_rate",
                         p_good.alias("p_good"), (p_good >= threshold).alias("keep"))


def url_site(url: Column) -> Column:
    """Host of a URL, lower case, without ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


def url_path(url: Column, depth: int = 1) -> Column:
    """The first ``depth`` parts of a URL's path."""
    return F.regexp_extract(url, rf"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*((?:/[^/?#]+){{0,{depth}}})", 1)
