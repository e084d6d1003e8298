"""URL filter: allow and block rules, and logistic regression on hashed character n-grams for the rest.

DataFrame and SQL functions only. The labelled table is small and of fixed size, so all of its training is
one row: gradient descent in the span of the training rows, which is where it stays from a zero start. The
weights are a scalar subquery of a fixed number of buckets; scoring is a projection without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with all its subdomains, and paths that start as given. ``text`` is host/path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1] if "/" in self.text else ""


@dataclass(frozen=True)
class Regression:
    """``expected``: the share of unwanted urls to reckon with, which moves the bias from the labelled table's share."""

    buckets: int = 131_072
    sizes: tuple[int, ...] = (3, 4, 5)
    steps: int = 200
    rate: float = 1.0
    decay: float = 1e-3
    pull: float = 6.0
    threshold: float = 0.5
    expected: float = 0.2


#: The rules in force.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)

#: Hosts of the labelled table. Unwanted: gambling, pharmacy, adult, advertising, link farms, fraud.
UNWANTED = """
online-casino casino-royal casino-bonus casino-slots mega-casino jackpot-win win-big lucky-win win-cash poker-win
free-bets sports-bets bets-today live-bets best-bets cheap-pills buy-pills diet-pills pills-shop cheap-meds
viagra-pills cheap-rx adult-cam adult-video adult-x xxx-adult x-rated sex-chat hot-adult ads-server ads-track
track-ads ads-network popup-ads click-ads ad-track click-track spam-links spam-farm link-farm content-farm
seo-spam free-money free-loans payday-loans cheap-loans fast-cash free-gift free-iphone crypto-win bitcoin-double
casino-win cheap-watches replica-cheap free-download-crack spam-mailer
""".split()

#: Ordinary sites: places, trades, sciences, pastimes, plain words.
ORDINARY = """
city-library gardening harbour weather software university recipes travel-notes museum science-daily history
bicycles theatre orchestra open-data hospital mathematics railway thread thornton winter-sports better-homes
heather roads farmers-market oneself nation editing northern southern weatherman gathering feathers another
mother-earth together teacher lettering printing painting engineering learning morning-news evening-post
stations relations foundation education translation tradition thirteen weaving thinking ringing hearing
ordering shorelines bakery carpentry chemistry botany geology astronomy archives poetry novels radio festival
swimming hiking photography letters maps schools villages rivers mountains islands forests
thesis
""".split()


def labelled_urls() -> tuple[tuple[str, int], ...]:
    """The small labelled table: each host twice, with subdomains, domains and paths in Latin squares, so that these say nothing of the label."""
    subs, langs, ends = ("", "www.", "blog.", "m."), ("en", "de", "fr", "es"), ("", ".html", "/")
    tops = ("test", "example.com", "example.net", "example.org")
    out = []
    for label, hosts in ((1, UNWANTED), (0, ORDINARY)):
        for i, h in enumerate(hosts):
            for k in (2 * i, 2 * i + 1):
                x, y = k // 4, k % 4
                out.append((f"https://{subs[y]}{h}.{tops[(x + y) % 4]}/{langs[(x + 2 * y) % 4]}/{100 + k}{ends[k // 16 % 3]}", label))
    return tuple(out)


LABELLED = labelled_urls()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct(length, verdict, text), else null. Of equally long ones a block wins."""
    found = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("text"))) for r in rules]
    return F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<length: int, verdict: string, text: string>")


def grams(host: Column, path: Column, r: Regression) -> Column:
    """Distinct hash buckets of the character n-grams of host and path, any digit as 0."""
    line = F.translate(F.concat(F.lit("/"), host, F.lit(" "), path, F.lit(" ")), "123456789", "000000000")

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(line) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(line, i, F.lit(n))), F.lit(r.buckets)).cast("int"))

    each = [of_size(n) for n in r.sizes]
    return F.array_distinct(F.concat(*each))


def train(spark: SparkSession, labelled: tuple[tuple[str, int], ...] = LABELLED, r: Regression | None = None) -> DataFrame:
    """One row: bias, weights (array of ``buckets``). ``labelled`` is a small table in memory, at most 1000 rows."""
    r = r or Regression()
    if len(labelled) > 1000:
        raise ValueError("the labelled table is meant to be small")
    values = ", ".join(f"({i}, '{u.replace(chr(39), chr(39) * 2)}', {float(y)}D)" for i, (u, y) in enumerate(labelled))
    if not labelled:
        return spark.range(1).select(F.lit(0.0).alias("bias"), F.array_repeat(F.lit(0.0), r.buckets).alias("weights"))
    host, path = parse(F.col("url"))
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(id, url, y)").select("id", "y", grams(host, path, r).alias("f"))
    table = rows.agg(F.sort_array(F.collect_list(F.struct("id", "y", "f"))).alias("x"))
    # a row's features have length 1, so two rows' product is their overlap over the root of their sizes; 1 for the bias.
    # The rows of products are gathered by an aggregate, which keeps them from being worked out anew in each step.
    products = F.expr("transform(x, b -> 1 + size(array_intersect(a.f, b.f)) / sqrt(size(a.f) * size(b.f)))")
    table = table.select("x", F.explode("x").alias("a")).select(F.struct(F.col("a.id"), F.col("a.y"), F.col("a.f"), products.alias("k")).alias("r"))
    table = table.agg(F.sort_array(F.collect_list("r")).alias("x"))
    step = f"""aggregate(sequence(1, {r.steps}), transform(x, a -> 0D), (w, i) -> zip_with(x, w, (a, v) ->
        v * {1 - r.rate * r.decay}D + {r.rate * r.pull / len(labelled)}D * (a.y - 1 / (1 + exp(- aggregate(zip_with(a.k, w, (p, q) -> p * q), 0D, (p, q) -> p + q))))))"""
    each = table.select("x", F.expr(step).alias("w")).select(F.explode(F.arrays_zip("x", "w")).alias("z"))
    parts = F.expr("concat(array(named_struct('bucket', -1, 'v', z.w)), transform(z.x.f, b -> named_struct('bucket', b, 'v', z.w / sqrt(size(z.x.f)))))")
    weights = each.select(F.explode(parts).alias("e")).groupBy(F.col("e.bucket").cast("long").alias("bucket")).agg(F.sum("e.v").alias("v"))
    dense = spark.range(-1, r.buckets).withColumnRenamed("id", "bucket").join(weights, "bucket", "left")
    dense = dense.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("v", F.lit(0.0)).alias("v")))).alias("all")).select(F.col("all.v").alias("v"))
    share = sum(y for _, y in labelled) / len(labelled)
    shift = math.log(r.expected / (1 - r.expected)) - (math.log(share / (1 - share)) if 0 < share < 1 else 0.0)
    return dense.select((F.col("v")[0] + F.lit(shift)).alias("bias"), F.slice("v", 2, r.buckets).alias("weights"))


def url_filter(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED, r: Regression | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row.

    ``verdict``: the longest fitting rule's, else block where the regression's score reaches its threshold.
    Null url or one without ``://``: host and path empty, no rule, judged by the bias. Repeated rows are
    judged alike. Extra columns are dropped. Empty table: no rows.
    """
    r = r or Regression()
    model = train(pages.sparkSession, labelled, r).select(F.struct("bias", "weights")).scalar()
    host, path = parse(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("f", grams(F.col("host"), F.col("path"), r))
    rows = rows.withColumn("m", model)
    total = F.aggregate(F.transform("f", lambda b: F.col("m.weights")[b]), F.lit(0.0), lambda p, q: p + q)
    rows = rows.withColumn("score", 1 / (1 + F.exp(-(F.col("m.bias") + total / F.sqrt(F.size("f"))))))
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("score") >= r.threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("rule.text").alias("rule"), verdict.alias("verdict"), "score")
