"""Mixing sources to target shares of tokens: soft memberships, projected gradient for the document rates, exact counts."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.checkpoints import cut_lineage
from quarryline.functions.joins import join_small

#: Default vocabulary (ranks of a public byte-level tokenizer) and the public pattern that splits texts before it. The driver reads the file and sends it to the tasks.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Labelled rows that the classifier is fitted on (about so many, drawn by the hash of their id), and the number of its hashed features.
SAMPLE_ROWS, FEATURES = 10_000, 4_096
#: Part of a labelled document's membership that its text decides; the rest belongs to its label.
SOFTNESS = 0.1
#: Memberships are rounded to parts of one so large; documents of one source with equal memberships are one cell of the fit.
PARTS = 16
#: Buckets in which fractions are rounded: so many for each power of e in size, times so many by hash.
SIZES, SALTS = 64, 64


@lru_cache(2)
def tokenizer(ranks: bytes):
    """The tokenizer of the content of a rank file; built once per worker."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def read_ranks(spark: SparkSession, path: str):
    """The content of a rank file (a few megabytes, as vocabularies are), broadcast; executors need no file of their own."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def fit_memberships(documents: DataFrame, sources: list[str], ranks, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Log-weights (source x feature, the last column the prior) of a naive Bayes classifier over hashed tokens, fitted on a bounded labelled sample.

    A source without a labelled document has nothing to be told by: its prior is 0, so no document is a member of it.
    """
    index = {s: i for i, s in enumerate(sources)}
    labelled = documents.filter(F.col("source").isin(sources) & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "source", "text")
    share = min(1.0, sample_rows / max(1, labelled.count()))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("source", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(sources), FEATURES + 1))
        for b in batches:
            for s, t in zip(b["source"], b["text"]):
                np.add.at(seen[index[s]], np.unique(np.array(tokenizer(ranks.value).encode_ordinary(t), dtype=int) % FEATURES), 1)
                seen[index[s], FEATURES] += 1
        at = np.nonzero(seen)
        yield pd.DataFrame({"s": at[0].astype("int32"), "f": at[1].astype("int32"), "n": seen[at]})

    table = np.zeros((len(sources), FEATURES + 1))
    for s, f, n in sample.mapInPandas(count, "s int, f int, n double").groupBy("s", "f").agg(F.sum("n")).collect():
        table[s, f] = n
    weights = np.log((table[:, :FEATURES] + 0.5) / (table[:, FEATURES:] + 1.0))
    known = table[:, FEATURES] > 0
    prior = np.where(known, np.log((table[:, FEATURES] + 1) / (table[:, FEATURES].sum() + max(1, known.sum()))), -np.inf)
    return np.concatenate([weights, prior[:, None]], 1)


def posterior(weights: np.ndarray, ids: list[int]) -> np.ndarray:
    """Memberships of a text with these tokens; the evidence is divided by the root of the number of features, as they depend on one another."""
    seen = np.unique(np.array(ids, dtype=int) % FEATURES)
    score = weights[:, FEATURES] + (weights[:, seen].sum(1) / max(1.0, np.sqrt(len(seen))) if len(seen) else 0)
    if not np.isfinite(score).any():
        return np.zeros(len(score))
    p = np.exp(score - score.max())
    return p / p.sum()


def cell_of(p: np.ndarray, parts: int = PARTS) -> str:
    """Memberships as text, in whole parts of one by largest remainder: ``3:12,5:4``."""
    whole = np.floor(p * parts + 1e-9)
    for i in np.argsort(-(p * parts - whole), kind="stable")[: int(round(p.sum() * parts - whole.sum()))]:
        whole[i] += 1
    return ",".join(f"{i}:{int(whole[i])}" for i in np.flatnonzero(whole))


def memberships_of(cells: list[str], k: int, parts: int = PARTS) -> np.ndarray:
    """The rows of memberships that the texts stand for."""
    out = np.zeros((len(cells), k))
    for row, cell in zip(out, cells):
        for part in cell.split(","):
            i, n = part.split(":")
            row[int(i)] = int(n) / parts
    return out


def _memberships(documents: DataFrame, sources: list[str], vocabulary: str, softness: float, sample_rows: int) -> DataFrame:
    """(doc_id, domain, tokens, cell): one row a document with its size, its source with a target (its label, else the likeliest) and its memberships."""
    rows = documents.select("doc_id", "source", "text").filter("doc_id is not null")
    ranks = read_ranks(rows.sparkSession, vocabulary)
    weights = rows.sparkSession.sparkContext.broadcast(fit_memberships(rows, sources, ranks, sample_rows))
    index, kind = {s: i for i, s in enumerate(sources)}, documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, s, t in zip(b["doc_id"], b["source"], b["text"]):
                if s is not None and s not in index:
                    continue
                ids = tokenizer(ranks.value).encode_ordinary(t or "")
                p = posterior(weights.value, ids) if ids else np.zeros(len(sources))
                if s is not None:
                    own = np.zeros(len(sources))
                    own[index[s]] = 1.0
                    p = (1 - softness) * own + softness * (p if p.any() else own)
                if ids and p.any():
                    out.append((k, index[s] if s is not None else int(p.argmax()), len(ids), cell_of(p)))
            yield pd.DataFrame(out, columns=["doc_id", "domain", "tokens", "cell"])

    sized = rows.mapInPandas(run, f"doc_id {kind}, domain int, tokens long, cell string")
    return sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "domain", "cell")).alias("x")).select("doc_id", "x.domain", "x.tokens", "x.cell")


def _rates(p: np.ndarray, domain: np.ndarray, cap: np.ndarray, history: list[tuple[bool, np.ndarray]]) -> np.ndarray:
    """The rates after the steps taken so far, all projected to [0, cap]: soft ones move against the memberships' share of the step, hard ones against that of the own source."""
    r = np.zeros(len(p))
    for soft, step in history:
        r = np.clip(r - (p @ step if soft else step[domain]), 0.0, cap)
    return r


def _totals(cells: DataFrame, k: int, history: list[tuple[bool, np.ndarray]]) -> np.ndarray:
    """Per source: expected tokens, tokens by label, tokens by label that could still rise, that could still fall, and all expected tokens at rate 1; summed in partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((k, 5))
        for b in batches:
            p, domain, cap, t = memberships_of(b["cell"].tolist(), k), b["domain"].to_numpy(), b["cap"].to_numpy(), b["tokens"].to_numpy(dtype=float)
            r = _rates(p, domain, cap, history)
            out[:, 0] += (r * t) @ p
            out[:, 4] += t @ p
            for j, x in ((1, r * t), (2, t * (r < cap)), (3, t * (r > 0))):
                out[:, j] += np.bincount(domain, x, k)
        yield pd.DataFrame({"i": np.arange(k), **{f"x{j}": out[:, j] for j in range(5)}})

    table = np.zeros((k, 5))
    for i, *x in cells.mapInPandas(run, "i int, x0 double, x1 double, x2 double, x3 double, x4 double").groupBy("i").agg(*(F.sum(f"x{j}") for j in range(5))).collect():
        table[i] = x
    return table


def fit_rates(cells: DataFrame, weights: list[float], rounds: int = 12, finish: int = 6, tolerance: float = 1e-4) -> tuple[list[tuple[bool, np.ndarray]], np.ndarray]:
    """Projected gradient for the least squares between expected tokens per source and targets; the steps taken, and the targets in tokens.

    The targets' total is the largest at which every source reaches its share within the caps. A step divides the gradient by each source's expected tokens at rate 1 (memberships add up to 1, so
    the iteration can't diverge, however memberships overlap). Further steps then move each source as a whole, until the tokens by label meet the targets as well. Rates are a function of a cell
    (source and memberships), so each step is a sum over cells; only vectors with an entry a source reach the driver.
    """
    k = len(weights)
    reach = _totals(cells, k, [(False, np.full(k, -1e18))])[:, 1]
    share = np.array(weights) * (reach > 0)
    share = share / share.sum() if share.sum() else share
    possible = [reach[i] / share[i] for i in range(k) if share[i] > 0]
    target = share * (min(possible) if possible else 0.0)
    history: list[tuple[bool, np.ndarray]] = []
    if not target.sum():
        return history, target
    for soft, most in ((True, rounds), (False, finish)):
        for _ in range(most):
            now = _totals(cells, k, history)
            gap = now[:, 0 if soft else 1] - target
            if np.abs(gap).max() <= tolerance * target.sum():
                break
            room = now[:, 4] if soft else np.where(gap > 0, now[:, 3], now[:, 2])
            history.append((soft, np.where(room > 0, gap / np.maximum(room, 1e-9), 0.0)))
    return history, target


def mix_sources(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, softness: float = SOFTNESS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Selected documents with the number of their copies, such that sources have their target shares of the tokens.

    A classifier, fitted on about ``sample_rows`` labelled documents, gives every document a posterior over the sources with a target. One with such a source is a member of it and, by the part
    ``softness``, of all by its posterior; one without a source is a member by its posterior alone and counts to the likeliest; one of a source without a target is not used. Rates are
    fitted by projected gradient; fractions are rounded along the order of size, and single copies are then added or taken away until each source is within one document of its target.

    Defined cases: weights are scaled to add up to 1 over the sources that have documents, so a target without documents leaves its share to the rest; null, NaN or
    negative weights count as 0, null caps as 1; a source listed twice has its first row by weight. Null ids are left out, repeated rows count once, null or empty texts have no
    tokens and are never taken. Without documents or targets the result is empty. The list of targets is one of stated size, held by the driver and the tasks.

    Returns doc_id, source (its own, or the likeliest), tokens, n_copies, rate.
    """
    listed = targets.filter("source is not null").groupBy("source").agg(F.max(F.struct(F.coalesce(F.when(F.isnan("target_weight") | (F.col("target_weight") < 0), 0.0).otherwise(F.col("target_weight")), F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("m"))).alias("x")).orderBy("source").collect()
    sources, weights, caps = [r["source"] for r in listed], [float(r["x"]["w"]) for r in listed], [max(0, int(r["x"]["m"])) for r in listed]
    kind, spark = documents.schema["doc_id"].dataType.simpleString(), documents.sparkSession
    if not sources:
        return spark.createDataFrame([], f"doc_id {kind}, source string, tokens long, n_copies int, rate double")
    names, limits = F.array(*map(F.lit, sources)), F.array(*map(F.lit, caps))
    docs = cut_lineage(_memberships(documents, sources, vocabulary, softness, sample_rows).withColumn("cap", F.get(limits, F.col("domain")).cast("double")))
    cells = cut_lineage(docs.groupBy("domain", "cell", "cap").agg(F.sum("tokens").alias("tokens")))
    history, target = fit_rates(cells, weights)
    k = len(sources)

    @F.pandas_udf("double")
    def rate(cell: pd.Series, domain: pd.Series, cap: pd.Series) -> pd.Series:
        codes, unique = pd.factorize(cell)
        return pd.Series(_rates(memberships_of(list(unique), k)[codes], domain.to_numpy(), cap.to_numpy(), history) if len(cell) else np.zeros(0))

    counted = cut_lineage(_whole_counts(docs.select("doc_id", "domain", "tokens", "cap", rate("cell", "domain", "cap").alias("rate"))))
    exact = _to_the_target(counted, target)
    return exact.filter("n_copies > 0").select("doc_id", F.get(names, F.col("domain")).alias("source"), "tokens", "n_copies", F.round("rate", 9).alias("rate"))


def _upto(rows: DataFrame, value: str, bucket: str, order: list[str], most: Column | None = None) -> DataFrame:
    """Adds ``upto``, the sum of ``value`` along (bucket, order) within a domain; buckets have offsets of their own, so a domain of any size is spread over tasks. Buckets that begin beyond ``most`` are left out."""
    sums = rows.groupBy("domain", bucket).agg(F.sum(value).alias("_s"))
    offset = F.coalesce(F.sum("_s").over(Window.partitionBy("domain").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.withColumn("_offset", offset).drop("_s")
    if most is not None:
        sums = sums.filter(F.col("_offset") <= most)
    inner = Window.partitionBy("domain", bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, ["domain", bucket]).withColumn("upto", F.col("_offset") + F.sum(value).over(inner)).drop("_offset")


def _whole_counts(rated: DataFrame) -> DataFrame:
    """Whole numbers of copies: the fractions are summed along the documents of a source in order of size, and a copy is taken where the sum passes a whole number and a half. Neighbours in size so stand for one another."""
    base = F.floor("rate").cast("double")
    rows = rated.withColumn("part", F.col("rate") - base).withColumn("base", base.cast("int")).withColumn("h", F.xxhash64("doc_id"))
    rows = rows.withColumn("bucket", F.floor(F.log(F.col("tokens").cast("double")) * SIZES) * SALTS + F.pmod("h", F.lit(SALTS)))
    summed = _upto(rows, "part", "bucket", ["tokens", "h", "doc_id"])
    extra = F.floor(F.col("upto") + 0.5) > F.floor(F.col("upto") - F.col("part") + 0.5)
    return summed.select("doc_id", "domain", "tokens", "cap", "rate", F.least(F.col("base") + F.when(extra, 1).otherwise(0), F.col("cap").cast("int")).alias("n_copies"))


def _to_the_target(counted: DataFrame, target: np.ndarray) -> DataFrame:
    """One copy more, or less, of as many documents of a source as bring its tokens to the target, up to half a document; they are taken in the order of a hash."""
    got = np.zeros(len(target))
    for domain, x in counted.groupBy("domain").agg(F.sum(F.col("tokens") * F.col("n_copies"))).collect():
        got[domain] = x
    lack = F.get(F.array(*(F.lit(float(x)) for x in target - got)), F.col("domain"))
    able = counted.withColumn("lack", lack).filter(((F.col("lack") > 0) & (F.col("n_copies") < F.col("cap"))) | ((F.col("lack") < 0) & (F.col("n_copies") > 0)))
    rows = able.select("doc_id", "domain", "lack", F.col("tokens").cast("double").alias("t"), F.xxhash64("doc_id").alias("h")).withColumn("bucket", F.shiftright("h", 52))
    picked = _upto(rows, "t", "bucket", ["h", "doc_id"], F.abs(lack)).filter(F.col("upto") - F.col("t") / 2 <= F.abs("lack"))
    moved = join_small(counted, picked.select("doc_id", F.signum("lack").cast("int").alias("move")), ["doc_id"], how="left")
    return moved.withColumn("n_copies", F.col("n_copies") + F.coalesce("move", F.lit(0))).drop("move")


def reached_shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reachable_share, reached_share, tokens, n_documents, n_copies) of every source with a target.

    ``target_share`` is of all listed weights, ``reachable_share`` of the weights of those sources that have documents, ``reached_share`` of the tokens selected.
    """
    own = selected.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_copies")).alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.sum("n_copies").alias("n_copies"))
    listed = targets.filter("source is not null").groupBy("source").agg(F.max(F.when(F.isnan("target_weight") | (F.col("target_weight") < 0), 0.0).otherwise(F.coalesce("target_weight", F.lit(0.0)))).alias("w"))
    joined = listed.join(own, "source", "left").withColumn("there", F.when(F.col("tokens") > 0, F.col("w")).otherwise(0.0))
    # a row a source with a target
    every = Window.partitionBy()
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    return joined.select(
        "source", F.coalesce(F.try_divide("w", F.sum("w").over(every)), none).alias("target_share"), F.coalesce(F.try_divide("there", F.sum("there").over(every)), none).alias("reachable_share"),
        F.coalesce(F.col("tokens") / F.sum("tokens").over(every), none).alias("reached_share"), *(F.coalesce(c, zero).alias(c) for c in ("tokens", "n_documents", "n_copies")),
    )
