"""URL filter: fixed rules first, then an empirical-Bayes reputation of hosts.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's share of good pages is shrunk
towards the level above by a beta prior whose weight is estimated from how much the level's groups scatter. A host is
blocked when the upper bound of its posterior stays below a floor. Counting combines before the shuffle; pages meet
their host's posterior in one join whose page side can be split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import ascii_lower


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules in force.
RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)
#: Block when even this many standard deviations above its posterior mean a host's share of good pages is below FLOOR.
FLOOR, DEVIATIONS = 0.7, 1.645
#: Bounds of the estimated correlation of pages within a group; the prior weighs as much as 1 / correlation - 1 pages.
LEAST_CORRELATION, MOST_CORRELATION = 0.005, 0.5


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with `host` and `path` of `url`; both empty for null and for what has no `://`."""
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise("")
    place = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(place) + 1, F.length(text)), r"^[^?#]*", 0)
    return pages.withColumns({"host": ascii_lower(place), "path": path})


def matching_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of `name` and `verdict`; null if none does."""
    chosen = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Posterior of each of the distinct `hosts`: `a`, `b`, `mean` and `upper`.

    `outcomes` has a row per labelled page: `host` and `good` (0 or 1; nulls do not count). Hosts without outcomes get
    their domain's or suffix's mean as prior. The registered domain is the last two labels, the suffix the last.
    """
    levels = hosts.withColumns({
        "domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)
    })
    counted = outcomes.where("good IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("g")
    )
    by_host = levels.join(counted, "host", "left").fillna(0, ["n", "g"])
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n_d"), F.sum("g").alias("g_d"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n_d").alias("n_s"), F.sum("g_d").alias("g_s"))
    total = by_suffix.agg(F.sum("n_s"), F.sum("g_s")).first()
    n, g = total[0] or 0, total[1] or 0
    m0 = (g + 1) / (n + 2)

    k = prior_weight(by_suffix, "n_s", "g_s", F.lit(m0))
    by_suffix = by_suffix.select("suffix", _shrunk("n_s", "g_s", F.lit(m0), k).alias("m_s"))
    by_domain = by_domain.join(by_suffix, "suffix")
    k = prior_weight(by_domain, "n_d", "g_d", F.col("m_s"))
    by_domain = by_domain.select("domain", _shrunk("n_d", "g_d", F.col("m_s"), k).alias("m_d"))
    by_host = by_host.join(by_domain, "domain")
    k = prior_weight(by_host, "n", "g", F.col("m_d"))
    a, b = F.col("m_d") * k + F.col("g"), (1 - F.col("m_d")) * k + F.col("n") - F.col("g")
    out = by_host.select("host", a.alias("a"), b.alias("b")).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1))
    return out.withColumn("upper", F.col("mean") + DEVIATIONS * spread)


def _shrunk(n: str, g: str, mean: Column, k: float) -> Column:
    return (mean * k + F.col(g)) / (F.col(n) + k)


def prior_weight(groups: DataFrame, n: str, g: str, mean: Column) -> float:
    """Pages that the level's prior is worth: groups that scatter more than chance would get a lighter one."""
    chi = (F.col(g) - F.col(n) * mean) * (F.col(g) - F.col(n) * mean) / (F.col(n) * mean * (1 - mean))
    row = groups.where(F.col(n) > 1).agg(
        F.sum(chi).alias("chi"), F.count(F.lit(1)).alias("groups"), F.sum(F.col(n) - 1).alias("free")
    ).first()
    rho = (row["chi"] - row["groups"]) / row["free"] if row["free"] else 0.0
    rho = min(max(rho, LEAST_CORRELATION), MOST_CORRELATION)
    return round(1 / rho - 1, 3)


def judge_urls(
    pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id",
    rules: tuple[Rule, ...] = RULES, floor: float = FLOOR,
) -> DataFrame:
    """One row per page: id, `host`, `path`, `rule` (name or null), `verdict` and `upper` (posterior bound).

    A page is labelled where `labels` has its id; each label row counts. Good is quality 1 without toxic 1; a null
    quality is no outcome. Pages without a host share the empty one. Null ids meet no label. Repeated pages stay.
    Without any labels every host has the same prior and passes.
    """
    known = with_host(pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url")), "_url")
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)
    marks = labels.select(F.col(label_id).alias("_id"), good.cast("int").alias("good"))
    outcomes = known.select("_id", "host").join(marks, "_id").select("host", "good")
    reputation = host_reputation(known.select("host").distinct(), outcomes)
    judged = known.join(reputation, "host").withColumn("_rule", matching_rule(rules, F.col("host"), F.col("path")))
    by_method = F.when(F.col("upper") < floor, "block").otherwise("allow")
    return judged.select(
        F.col("_id").alias(page_id), "host", "path", F.col("_rule.name").alias("rule"),
        F.coalesce("_rule.verdict", by_method).alias("verdict"), "upper",
    )
