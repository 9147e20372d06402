"""Anomaly analytics on vectors: distances to a bank, calibration, scores, thresholds, metrics, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import euclidean, ratio, softmax_weight, top_k_count

VIEWS, PATCHES = 4, 16
#: Vectors of a block where all meet all, the least number of blocks, and vectors that ask at a time.
BLOCK_ROWS, LEAST_BLOCKS, CHUNK = 16_384, 4, 256
# The candidates of the model selection.
EPSILON_RATIOS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.2)
FLOOR_RATIOS = (0.05, 0.1, 0.2)
SHRINKAGES = (0.05, 0.1, 0.25, 0.5)
MAD_RATIOS = (0.001, 0.01, 0.1)
MAP_PERCENTILES = (95.0, 97.0, 98.0, 98.5, 99.0, 99.25, 99.5, 99.75, 99.9, 100.0)
TOP_K_PERCENTS = (0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 20.0, 25.0)
COMPLEXITY = {"std_floor": 0, "epsilon": 1, "shrinkage": 2, "mad": 3, "none": 99}
#: Percentiles of the threshold search: first, last, how many.
SEARCH = (90.0, 100.0, 1001)


def normalizations() -> list[tuple[str, float]]:
    return [(m, v) for m, values in (("epsilon", EPSILON_RATIOS), ("std_floor", FLOOR_RATIOS), ("shrinkage", SHRINKAGES), ("mad", MAD_RATIOS)) for v in values]


def aggregations() -> list[tuple[str, float]]:
    return [("percentile", p) for p in MAP_PERCENTILES] + [("top_k_percent_average", p) for p in TOP_K_PERCENTS]


def patches(embeddings: DataFrame) -> DataFrame:
    """vec_id, split, view, patch, value: each vector as four views of sixteen patches."""
    rows = embeddings.select("vec_id", (F.col("vec_id") % 5).alias("split"), F.posexplode("embedding").alias("pos", "value"))
    return rows.select("vec_id", "split", F.floor(F.col("pos") / PATCHES).cast("int").alias("view"), (F.col("pos") % PATCHES).cast("int").alias("patch"), F.col("value").cast("double").alias("value"))


def _nearest_in_block(asking, held, k: int):  # noqa: ANN001, ANN202
    """The k nearest of ``held`` for each vector of ``asking`` but itself, as a pandas frame. Products find the candidates; their distances are sums of squared differences."""
    import numpy as np
    import pandas as pd

    held = held.sort_values("bank_id")
    ids, bank = held["bank_id"].to_numpy(), np.stack(held["bank_vec"].to_numpy()).astype(float)
    lengths, found = (bank * bank).sum(1), []
    for start in range(0, len(asking), CHUNK):
        part = asking.iloc[start : start + CHUNK]
        own, q = part["vec_id"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype(float)
        norms = (q * q).sum(1)[:, None]
        far = norms + lengths - 2 * (q @ bank.T)
        far[own[:, None] == ids] = np.inf
        last = np.partition(far, min(k, len(ids)) - 1, axis=1)[:, [min(k, len(ids)) - 1]]
        row, col = np.nonzero((far <= last + 1e-9 * (norms + lengths.max())) & np.isfinite(far))  # wider than the rounding of the products
        squares = np.zeros(len(row))
        for i in range(bank.shape[1]):
            squares += (q[row, i] - bank[col, i]) ** 2
        order = np.lexsort((col, squares, row))
        row, col, squares = row[order], col[order], squares[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, squares = row[rank < k], col[rank < k], squares[rank < k]
        found.append(pd.DataFrame({"vec_id": own[row], "bank_id": ids[col], "distance": np.sqrt(squares)}))
    return pd.concat(found)


def nearest_others(vectors: DataFrame, k: int, block: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, bank_id, distance, rank: the k nearest of all other vectors for every vector, block against block."""
    rows = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
    n = max(LEAST_BLOCKS, -(-rows.count() // block))
    blocks, own = F.sequence(F.lit(0), F.lit(n - 1)), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    asking = rows.select(own.alias("i"), F.explode(blocks).alias("j"), "vec_id", "embedding")
    held = rows.select(F.explode(blocks).alias("i"), own.alias("j"), F.col("vec_id").alias("bank_id"), F.col("embedding").alias("bank_vec"))
    schema = "vec_id bigint, bank_id bigint, distance double"

    def meet(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return _nearest_in_block(a, b, k) if len(a) and len(b) else pd.DataFrame({"vec_id": [], "bank_id": [], "distance": []})

    near = asking.groupBy("i", "j").cogroup(held.groupBy("i", "j")).applyInPandas(meet, schema)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy("distance", "bank_id"))).where(F.col("rank") <= k)


def reweighted(near: DataFrame) -> DataFrame:
    """Image score of the nearest distances: the nearest one, weighted by how much it stands out among them."""
    listed = near.groupBy("vec_id").agg(F.sort_array(F.collect_list("distance")).alias("d"))  # k entries
    return listed.select("vec_id", (softmax_weight(F.col("d")) * F.element_at("d", 1)).alias("score"))


def moments(rows: DataFrame) -> DataFrame:
    """view, patch, center, scale (sample deviation)."""
    return rows.groupBy("view", "patch").agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("scale"))


def medians(rows: DataFrame) -> DataFrame:
    """view, patch, center, scale (scaled median absolute deviation)."""
    center = rows.groupBy("view", "patch").agg(F.median("value").alias("center"))
    off = rows.join(F.broadcast(center), ["view", "patch"]).withColumn("off", F.abs(F.col("value") - F.col("center")))  # one row for each position
    return off.groupBy("view", "patch").agg(F.first("center").alias("center"), (F.median("off") * 1.4826).alias("scale"))


def references(calibrated: DataFrame) -> DataFrame:
    """view, reference (median of the positive scales), global variance."""
    positive = F.when(F.col("scale") > 0, F.col("scale"))
    return calibrated.groupBy("view").agg(F.median(positive).alias("reference"), F.avg(F.col("scale") * F.col("scale")).alias("global_variance"))


def denominator(method: Column, option: Column) -> Column:
    """What a method divides by."""
    s, r = F.col("scale"), F.col("reference")
    return (
        F.when(method.isin("epsilon", "mad"), s + option * r)
        .when(method == "std_floor", F.greatest(s, option * r))
        .when(method == "shrinkage", F.sqrt((1 - option) * s * s + option * F.col("global_variance")) + F.greatest(F.lit(1e-12), r * 1e-6))
        .otherwise(F.lit(1.0))
    )


def calibration(rows: DataFrame, methods: list[tuple[str, float]] | None = None) -> DataFrame:
    """method, option, view, patch, center, denominator of calibration rows; both statistics come from one pass each."""
    spark = rows.sparkSession
    options = spark.createDataFrame(methods or normalizations(), "method string, option double")
    parts = []
    for names, stats in ((("epsilon", "std_floor", "shrinkage"), moments(rows)), (("mad",), medians(rows))):
        wanted = options.where(F.col("method").isin(*names))
        full = stats.join(F.broadcast(references(stats)), "view")  # a row for each view
        parts.append(full.join(F.broadcast(wanted)).select("method", "option", "view", "patch", "center", denominator(F.col("method"), F.col("option")).alias("denominator")))  # at most 18 rows
    return parts[0].unionByName(parts[1])


def normalized(rows: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Rows under every method of the calibration (a table of fixed size: methods by positions)."""
    return rows.join(F.broadcast(calibrated), ["view", "patch"]).withColumn("z", (F.col("value") - F.col("center")) / F.col("denominator"))


def aggregate_map(ordered: Column, kind: str, option: float) -> Column:
    """Score of a map whose values ascend: a linear percentile (100 is the maximum), or the mean of its top share."""
    n = F.size(ordered)
    if kind == "percentile":
        if option == 100.0:
            return F.element_at(ordered, -1)
        place = (n - 1) * F.lit(option) / 100.0
        low = F.floor(place).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, n - 1))
        return a + (b - a) * (place - low)
    k = top_k_count(n, option).cast("int")
    return F.aggregate(F.reverse(F.slice(ordered, n - k + 1, k)), F.lit(0.0), lambda s, v: s + v) / k


def view_scores(z: DataFrame, kinds: list[tuple[str, float]] | None = None) -> DataFrame:
    """method, option, kind, level, vec_id, split, view, score: maps are gathered once (sixteen values) and scored under all aggregations."""
    maps = z.groupBy("method", "option", "vec_id", "split", "view").agg(F.sort_array(F.collect_list("z")).alias("m"))
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("level"), aggregate_map(F.col("m"), k, p).alias("score")) for k, p in kinds or aggregations()])
    return maps.select("method", "option", "vec_id", "split", "view", F.explode(listed).alias("s")).select("method", "option", "vec_id", "split", "view", "s.kind", "s.level", "s.score")


def grid_percentile(i: Column) -> Column:
    """The searched percentile of number ``i``, as a share."""
    first, last, count = SEARCH
    return (F.lit(first) + i * F.lit((last - first) / (count - 1))) / 100


def grid_below(limit: Column, n: Column) -> Column:
    """How many searched percentiles have a place among ``n`` sorted values that lies below ``limit``: an estimate, put right by its neighbours."""
    first, last, count = SEARCH
    guess = F.floor((100 * limit / F.greatest(n - 1, F.lit(1)) - first) / ((last - first) / (count - 1))) - 1
    near = [F.when((guess + j >= 0) & (guess + j < count) & (grid_percentile(guess + j) * (n - 1) < limit), 1).otherwise(0) for j in range(4)]
    return F.greatest(F.lit(0), F.least(guess, F.lit(count))) + sum(near[1:], near[0])


def search_thresholds(scores: DataFrame, target: float, keys: list[str], views: int = VIEWS) -> DataFrame:
    """The least of the searched percentiles at which no more than ``target`` of the products exceed any view's threshold.

    ``scores``: keys, vec_id, view, score of the calibration split. The thresholds are linear percentiles, so a score exceeds just those whose place
    lies below the first place of its own value: its rank says how many, without the thresholds. A product exceeds as long as its highest
    view does; the rates of all percentiles are then running counts. Only the chosen percentile's thresholds are looked up.
    """
    count, own = SEARCH[2], W.partitionBy(*keys, "view")
    ranked = scores.select(*keys, "vec_id", "view", "score", F.row_number().over(own.orderBy("score")).alias("place"), F.rank().over(own.orderBy("score")).alias("least"), F.count(F.lit(1)).over(own).alias("n"))
    worst = ranked.groupBy(*keys, "vec_id").agg(F.max(grid_below(F.col("least") - 1, F.col("n"))).alias("exceeds"))
    held = worst.groupBy(*keys, "exceeds").agg(F.count(F.lit(1)).alias("c"))  # at most one row for each percentile
    after = W.partitionBy(*keys).orderBy(F.desc("exceeds")).rowsBetween(W.unboundedPreceding, -1)
    rates = held.withColumn("above", F.coalesce(F.sum("c").over(after), F.lit(0))).withColumn("products", F.sum("c").over(W.partitionBy(*keys)))
    # a threshold must be positive: the place at which the sorted values cross 0 says which are
    low, high = F.max(F.when(F.col("score") <= 0, F.col("score"))), F.min(F.when(F.col("score") > 0, F.col("score")))
    signs = scores.groupBy(*keys, "view").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") <= 0).alias("negatives"), low.alias("low"), high.alias("high"))
    crossing = F.when(F.col("negatives") == 0, F.lit(-1.0)).when(F.col("high").isNull(), F.col("n").cast("double")).otherwise(F.col("negatives") - 1 - F.col("low") / (F.col("high") - F.col("low")))
    unsafe = signs.groupBy(*keys).agg(F.max(grid_below(crossing + F.lit(1e-9), F.col("n"))).alias("unsafe"), F.count(F.lit(1)).alias("views"))
    listed = rates.groupBy(*keys).agg(F.collect_list(F.struct("exceeds", "c")).alias("h"), F.max("products").alias("products"), F.min(F.when(F.col("above") / F.col("products") <= target, F.col("exceeds"))).alias("i"))
    chosen = listed.join(unsafe, keys).where((F.col("views") == views) & (F.col("products") >= 100)).withColumn("i", F.greatest("i", "unsafe")).where(F.col("i") < count)
    fpr = F.aggregate("h", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["exceeds"] > F.col("i"), x["c"]).otherwise(0)) / F.col("products")
    chosen = chosen.select(*keys, grid_percentile(F.col("i")).alias("share"), fpr.alias("fpr"))
    at = F.col("share") * (F.col("n") - 1)
    found = ranked.join(chosen, keys).where((F.col("place") - 1 == F.floor(at)) | (F.col("place") - 1 == F.ceil(at)))
    mixed = F.when(F.floor(at) == F.ceil(at), F.col("score")).when(F.col("place") - 1 == F.floor(at), F.col("score") * (F.ceil(at) - at)).otherwise(F.col("score") * (at - F.floor(at)))
    return found.groupBy(*keys, "view", "fpr", "share").agg(F.sum(mixed).alias("threshold")).select(*keys, (F.col("share") * 100).alias("percentile"), "fpr", "view", "threshold")


def predictions(scores: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vec_id, split, predicted: a product is NG if any view's score exceeds its threshold, strictly."""
    joined = scores.join(F.broadcast(thresholds.select(*keys, "view", "threshold")), [*keys, "view"])  # candidates by views, a fixed number
    return joined.groupBy(*keys, "vec_id", "split").agg(F.bool_or(F.col("score") > F.col("threshold")).cast("int").alias("predicted"))


def metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts and rates of truth and predicted (0 or 1); empty denominators give 0."""
    t, p = F.col("truth"), F.col("predicted")
    counts = rows.groupBy(*keys).agg(F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"), F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rated = counts.withColumns({"accuracy": ratio(tn + tp, tn + fp + fn + tp), "recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "fpr": ratio(fp, fp + tn)})
    return rated.withColumn("f1", ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_candidate(measured: DataFrame) -> DataFrame:
    """The candidate with the highest recall, then the lowest false positive rate, latency (``p95_ms``, where it was measured), complexity and name."""
    latency = ["p95_ms"] if "p95_ms" in measured.columns else []
    return measured.orderBy(F.desc("recall"), "fpr", *latency, "complexity", "candidate_id").limit(1)


def histogram(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Counts in equal bins over the range of all values; between 10 and 80 bins, twice the root of the count."""
    bounds = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.greatest(F.lit(10), F.least(F.lit(80), 2 * F.floor(F.sqrt(F.count(F.lit(1)))))).cast("int").alias("bins"))
    width = (F.col("high") - F.col("low")) / F.col("bins")
    place = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("low")) / width), F.col("bins") - 1)).cast("int")
    return rows.join(F.broadcast(bounds)).groupBy(by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row


def timing_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, linear percentiles and bounds of a column."""
    q = F.expr(f"percentile({value}, array(0.5, 0.95, 0.99))")
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), q.alias("q"), F.min(value).alias("least"), F.max(value).alias("most")).select(*by, "mean", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p95"), F.get("q", F.lit(2)).alias("p99"), "least", "most")


def continuous_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, and under each name the interpolated quantile of ``value`` at that share; groups without a value have no row.

    Between neighbours low * (1 - t) + high * t is rounded once after the product of high, as SQL engines do; ``percentile`` rounds both products, and where two quantiles are compared the last bit decides.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    own = W.partitionBy(*by)
    placed = counted.select(*by, value, F.sum("__n").over(own.orderBy(value)).alias("__upto"), (F.sum("__n").over(own) - 1).alias("__last"))
    at = lambda place: F.min(F.when(F.col("__upto") > place, F.col(value)))
    ends = {n: F.col("__last") * F.lit(q) for n, q in shares.items()}
    found = placed.groupBy(*by, "__last").agg(*[c for n, p in ends.items() for c in (at(F.floor(p)).alias(f"__low_{n}"), at(F.ceil(p)).alias(f"__high_{n}"))])

    def between(n: str) -> Column:
        low, high, t = F.col(f"__low_{n}"), F.col(f"__high_{n}"), ends[n] - F.floor(ends[n])
        return F.when(t == 0, low).otherwise(F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - t, high * t).cast("double"))

    return found.select(*by, *[between(n).alias(n) for n in shares])


def parallelism_choice(rows: DataFrame, key: str, faster: float = 0.95) -> DataFrame:
    """key, streams: of the measured numbers of streams, in their order, the last that is memory-safe, has a median of at most ``faster`` of the best's so far and no worse p95.

    ``rows``: key, streams, memory_safe, median_ms, p95_ms. A key whose single stream isn't safe or measured has no choice and no row.
    """
    listed = rows.where("memory_safe AND median_ms IS NOT NULL AND p95_ms IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("streams", "median_ms", "p95_ms"))).alias("c"))  # a few measurements
    better = lambda best, x: (x["median_ms"] <= best["median_ms"] * faster) & (x["p95_ms"] <= best["p95_ms"])
    best = F.aggregate(F.slice("c", 2, 1 << 20), F.element_at("c", 1), lambda best, x: F.when(better(best, x), x).otherwise(best))
    return listed.where(F.element_at("c", 1)["streams"] == 1).select(key, best["streams"].alias("streams"))


def ordered_digest(rows: DataFrame, by: list[str], name: str, order: list[str], line: Column, digits: int = 3) -> DataFrame:
    """by, digest: SHA-256 over the lines of each group, in two steps, so that no task sees all of a group.

    Rows go in chunks by the first ``digits`` hexadecimal digits of the SHA-256 of ``name``. A chunk's digest is over its lines in ``order``, each with a line end;
    the group's is over ``chunk digest`` lines in the order of the chunks. How rows are partitioned doesn't matter; one row more, less or changed does.
    """
    end = lambda c: F.concat(c, F.lit("\n"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"]), "")
    chunks = rows.groupBy(*by, F.substring(F.sha2(F.col(name).cast("binary"), 256), 1, digits).alias("chunk")).agg(F.sha2(joined(F.struct(*order, end(line).alias("line"))), 256).alias("digest"))
    return chunks.groupBy(*by).agg(F.sha2(joined(F.struct("chunk", end(F.concat_ws(" ", "chunk", "digest")).alias("line"))), 256).alias("digest"))
