"""URL filters: listed rules first, mined association rules for the rest.

Listed rules (host suffix and path prefix) judge the URLs they fit. Their
verdicts are the labels from which FP-growth learns: every labelled URL becomes
a set of tokens (all parts of host, path and query) plus its verdict, and rules
``tokens -> verdict`` with enough support and confidence are kept. Their counts
are then taken again over all labelled URLs, and a rule is pruned if a more
general one with the same verdict is at least as confident.
URLs that no listed rule fits are matched against the mined rules through an
inverted index from each rule's rarest token; the most confident rule decides.
Where none matches, the prior does: the more frequent verdict among the
labelled URLs.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MADE = ("host", "path", "rule", "verdict", "mined_rule", "confidence")

#: (verdict, host, path prefix)
LISTED = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Where not a single URL is labelled.
DEFAULT = "allow"
#: FP-growth counts all sets of the frequent tokens that occur together, so no
#: basket may hold more of them than this; see ``mine``.
BASKET = 16


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def listed_rule(host: Column, path: Column, listed=LISTED) -> Column:
    """Struct (rule, verdict) of the longest listed rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(listed, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        hit = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: labels of the host, path segments (numbers as
    ``#``), query keys and the scheme."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda x: x != ""),
        lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")),
    )
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0))
    )
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z]*)://", 1)))
    return F.array_distinct(F.concat(labels, segments, keys, scheme))


@dataclass(frozen=True)
class MinedRule:
    needs: frozenset
    verdict: str
    confidence: float
    support: float

    @property
    def name(self) -> str:
        return "+".join(sorted(self.needs))


def baskets_of(rows: DataFrame, min_support: float) -> tuple[DataFrame, float, dict[str, str]]:
    """Baskets of the frequent tokens of ``rows (tokens, verdict)``, the support
    that they need, and the token that stands for each frequent one.

    Rare tokens can't be in a frequent set and are left out. Tokens that occur
    in exactly the same rows (equal counts and equal sums of row hashes) tell
    the same, so one stands for any of them, here and when URLs are matched. If some basket still holds more
    than ``BASKET`` tokens, the support is doubled until none does: a bound on
    the number of sets that treats all tokens alike, wherever they stand.
    """
    rows = common.cut(rows.select("verdict", "tokens", F.monotonically_increasing_id().alias("row")))
    n = rows.count()
    each = rows.select("row", F.explode("tokens").alias("token"))
    marks = (F.xxhash64("row").cast("decimal(38,0)"), F.xxhash64("row", F.lit(1)).cast("decimal(38,0)"))
    counted = each.groupBy("token").agg(F.count("*").alias("n"), *(F.sum(m).alias(f"m{k}") for k, m in enumerate(marks)))
    counted = common.cut(counted.where(F.col("n") >= min_support * n))
    found = counted.collect()  # at most tokens per row / min_support rows
    first: dict = {}
    for r in sorted(found, key=lambda r: r.token):
        first.setdefault((r.n, r.m0, r.m1), r.token)
    stands = {r.token: first[(r.n, r.m0, r.m1)] for r in found}
    counts = {t: n_ for (n_, _, _), t in first.items()}
    support = min_support
    while True:
        names = sorted(t for t in counts if counts[t] >= support * n)
        kept = F.filter("tokens", lambda t: t.isin(names)) if names else F.array().cast("array<string>")
        # Of tokens that stand together the first is in the row whenever one is.
        baskets = rows.select(F.array_append(kept, F.concat(F.lit("="), F.col("verdict"))).alias("items"))
        most = baskets.agg(F.max(F.size("items"))).first()[0]
        if (most or 0) <= BASKET + 1:
            return baskets, support, stands
        support *= 2


def mine(
    rows: DataFrame, *, min_support: float = 0.002, min_confidence: float = 0.75, max_rows: int = 50_000
) -> tuple[list[MinedRule], str | None, dict[str, str]]:
    """Rules, the prior verdict and the token that stands for each frequent
    one, from rows ``(key, tokens, verdict)`` by FP-growth.

    The candidates for rules come from about ``max_rows`` labelled rows, drawn
    by a hash of their key (which should differ between rows of one URL, or a
    hot URL is drawn as a whole or not at all), with all their tokens; a rule
    needs ``min_support`` of the drawn rows, which bounds their number. The
    rules' support and confidence are counted over all labelled rows.
    """
    rows = rows.where("verdict IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("verdict").count().collect()}
    n = sum(counts.values())
    if not n:
        return [], None, {}
    prior = min(counts, key=lambda v: (-counts[v], v))
    share = min(1.0, max_rows / n)
    drawn = rows.where(F.xxhash64("key", F.lit(11)) / F.lit(float(1 << 64)) + 0.5 < share)
    baskets, support, stands = baskets_of(drawn, min_support)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(common.cut(baskets))
    found = (
        model.associationRules.where(F.col("consequent")[0].startswith("="))
        .where(~F.exists("antecedent", lambda x: x.startswith("=")))
        .select("antecedent", F.substring(F.col("consequent")[0], 2, 1 << 30).alias("verdict"))
        .collect()  # bounded by the support
    )
    needs = sorted({frozenset(r.antecedent) for r in found}, key=sorted)
    exact = _counted(rows, needs, stands)
    rules = []
    for at, need in enumerate(needs):
        held = {v: exact.get((at, v), 0) for v in counts}
        total = sum(held.values())
        rules += [
            MinedRule(need, v, k / total, k / n)
            for v, k in held.items()
            if total and k / total >= min_confidence and k / n >= support
        ]
    return pruned(rules), prior, stands


def _counted(rows: DataFrame, needs: list[frozenset], stands: dict[str, str]) -> dict[tuple[int, str], int]:
    """Labelled rows per token set and verdict, over all rows."""
    if not needs:
        return {}
    sets = rows.sparkSession.sparkContext.broadcast(needs)  # as many as rules

    def run(batches):
        import pyarrow as pa

        uses: dict = defaultdict(int)
        for need in sets.value:
            for t in need:
                uses[t] += 1
        index = defaultdict(list)
        for at, need in enumerate(sets.value):
            index[min(need, key=lambda t: (uses[t], t))].append((at, need))
        sums: dict = defaultdict(int)
        for batch in batches:
            for tokens_, verdict in zip(batch.column("tokens").to_pylist(), batch.column("verdict").to_pylist()):
                present = {stands.get(t, t) for t in tokens_}
                for t in present:
                    for at, need in index.get(t, ()):
                        if need <= present:
                            sums[at, verdict] += 1
        keys = list(sums)
        columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string())]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([sums[k] for k in keys], pa.int64())], names=["at", "verdict", "n"]
        )

    found = rows.select("tokens", "verdict").mapInArrow(run, "at long, verdict string, n long")
    return {(r.at, r.verdict): r.n for r in found.groupBy("at", "verdict").agg(F.sum("n").alias("n")).collect()}


def pruned(rules: list[MinedRule]) -> list[MinedRule]:
    """Rules without those that a more general one of their verdict makes needless."""
    kept: list[MinedRule] = []
    index: dict = defaultdict(list)
    for rule in sorted(rules, key=lambda r: (len(r.needs), r.name, r.verdict)):
        general = {id(g): g for t in rule.needs for g in index[t]}.values()
        if any(g.needs <= rule.needs and g.verdict == rule.verdict and g.confidence >= rule.confidence for g in general):
            continue
        kept.append(rule)
        for t in rule.needs:
            index[t].append(rule)
    return kept


def inverted(rules: list[MinedRule]) -> dict[str, list[MinedRule]]:
    """Rules by their rarest token among all rules."""
    uses: dict = defaultdict(int)
    for rule in rules:
        for t in rule.needs:
            uses[t] += 1
    index = defaultdict(list)
    for rule in rules:
        index[min(rule.needs, key=lambda t: (uses[t], t))].append(rule)
    return dict(index)


def decide(found: list[str], index: dict[str, list[MinedRule]]) -> MinedRule | None:
    """The most confident rule whose tokens all occur; ties: more support, then name."""
    present = set(found)
    hits = [r for t in present for r in index.get(t, ()) if r.needs <= present]
    return min(hits, key=lambda r: (-r.confidence, -r.support, r.name, r.verdict), default=None)


def filter_urls(
    pages: DataFrame,
    *,
    url: str = "url",
    page_id: str | None = "page_id",
    listed=LISTED,
    carry: list[str] | None = None,
    default: str = DEFAULT,
    **mining,
) -> DataFrame:
    """Judge every URL: listed rule, else mined rule, else the prior verdict
    (``default``, if not a single URL is labelled).

    Adds ``host``, ``path``, ``rule`` (listed rule or null), ``verdict``,
    ``mined_rule`` and ``confidence`` (null where a listed rule or the prior
    decides) to the columns ``carry`` (all, if None). Rows to learn from are
    drawn by ``page_id`` and URL.

    Defined cases: a null URL or one without ``://`` has an empty host and
    path, so no listed rule fits; long URLs count with all their tokens; if
    nothing passes the pruning, the prior decides; repeated rows each get
    their own verdict; an empty table gives no rows; input columns named like
    an output column are left out, other names are free.
    """
    common.bound_batches(pages.sparkSession)
    own = common.Own(pages, carry, MADE)
    keep = own.names
    drawn_by = F.xxhash64(*([common.named(page_id)] if page_id else []), common.named(url))
    staged = pages.select(*own.staged, common.named(url).alias("address"), drawn_by.alias("key"))
    staged = staged.withColumns({"host": host_of(F.col("address")), "path": path_of(F.col("address"))})
    staged = staged.withColumn("hit", listed_rule(F.col("host"), F.col("path"), listed))
    staged = staged.withColumn("tokens", tokens(F.col("address"), F.col("host"), F.col("path")))
    rules, prior, stands = mine(staged.select("tokens", F.col("hit.verdict").alias("verdict"), "key"), **mining)
    rules = pages.sparkSession.sparkContext.broadcast((rules, stands))  # both bounded by the support

    out = T.StructType(
        [
            *common.fields(staged, [*keep, "host", "path"]),
            T.StructField("rule", T.StringType()),
            T.StructField("verdict", T.StringType()),
            T.StructField("mined_rule", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
        ]
    )
    staged = staged.select(
        *keep,
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.col("hit.verdict").alias("verdict"),
        F.when(F.col("hit").isNull(), F.col("tokens")).alias("tokens"),
    )
    judged = staged.mapInArrow(_judge_batches([*keep, "host", "path"], rules, prior or default), out)
    return judged.select(*own.restored, "host", "path", "rule", "verdict", "mined_rule", "confidence")


def _judge_batches(keep: list[str], rules, default: str):
    def run(batches):
        import pyarrow as pa

        mined, stands = rules.value
        index = inverted(mined)
        for batch in batches:
            verdicts = batch.column("verdict").to_pylist()
            names: list = [None] * len(verdicts)
            confidences: list = [None] * len(verdicts)
            for k, found in enumerate(batch.column("tokens").to_pylist()):
                if found is None:
                    continue
                rule = decide([stands.get(t, t) for t in found], index)
                verdicts[k] = rule.verdict if rule else default
                if rule:
                    names[k], confidences[k] = rule.name, rule.confidence
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    batch.column("rule"),
                    pa.array(verdicts, pa.string()),
                    pa.array(names, pa.string()),
                    pa.array(confidences, pa.float64()),
                ],
                names=[*keep, "rule", "verdict", "mined_rule", "confidence"],
            )

    return run


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts for the URLs of all pages."""
    return filter_urls(common.table(spark, sf_dir, "pages"), carry=["page_id"])
