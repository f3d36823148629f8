"""URL filters: rules first, then trust propagated over host links, in DataFrame operations only.

Trust starts at hosts whose pages the rules allow and follows links; distrust
starts at hosts whose pages they block and goes against the links, to those that
link there. Both are personalised PageRanks.

``settle`` sums them by the length of the paths until what is missing cannot turn a
verdict. Nothing is subtracted, so a rank in floating point keeps its relative
precision however small its share of the table is, and whether a host is reached at
all is kept apart from the size of its rank.

``propagate`` does what the SQL can say, a fixed number of rounds. Its ranks are whole
numbers of 10**-12 and shares are divided without remainder, so sums do not depend on
the order of rows and a rerun agrees to the last unit; what is smaller or farther is lost.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.plans.storage import discard, materialize, small_side

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Absolute and scheme-relative link targets in HTML; relative links stay on their host.
LINK = r"(?i)\b(?:href|src)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"
SCALE, KEEP, STEPS = 10**12, 85, 8
#: Settled ranks: their whole, a power of two near the top of a double's range; least share passed on, 10**-601 of it; ranks closer than EQUAL of them count as equal.
WHOLE, LEAST_SHARE, EQUAL = 2.0**1000, 1e-300, 1e-12

#: The rules of the registered query: verdict and host/path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule's (rule, verdict), else null. A rule fits its host and its subdomains if the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Distinct (src, dst) hosts of links between different hosts."""
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))).alias("dst"))
    return found.select("src", _lower(F.col("dst")).alias("dst")).where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).distinct()


def propagate(seeds: DataFrame, links: DataFrame, steps: int = STEPS) -> DataFrame:
    """host, trust, distrust from seeds (the same columns) after ``steps`` rounds; one written table a round cuts the lineage.

    Each round is two equi-joins on the host, which AQE splits where a host has very
    many links, and one sum with partial aggregation.
    """
    out_degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))
    in_degree = links.groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))
    links = materialize(links.join(out_degree, "src").join(in_degree, "dst"), "host-links")
    ranks = seeds
    base = seeds.select("host", F.expr(f"trust * {100 - KEEP} div 100").alias("trust"), F.expr(f"distrust * {100 - KEEP} div 100").alias("distrust"))
    for _ in range(steps if not links.isEmpty() else 1):  # without links the ranks stay from the first round on
        forward = links.join(ranks.where("trust > 0").withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), F.expr(f"(trust * {KEEP} div 100) div out_degree").alias("trust"), F.lit(0).cast("long").alias("distrust"))
        backward = links.join(ranks.where("distrust > 0").withColumnRenamed("host", "dst"), "dst").select(F.col("src").alias("host"), F.lit(0).cast("long").alias("trust"), F.expr(f"(distrust * {KEEP} div 100) div in_degree").alias("distrust"))
        summed = base.unionByName(forward).unionByName(backward).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        ranks = materialize(summed, "host-ranks")
    return ranks


def settle(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """host, shut (more distrust than trust) from seeds (host, trust, distrust), after as many rounds as it takes.

    Round k adds the paths of k links. ``trust_hop`` is the round that first reached a
    host (null: trust is exactly 0). With the sums after k rounds in ``trust_old`` and
    those after 2k + 1 in ``trust``, of which none is more than (1 + b) times the old one,
    all later paths together add at most b * b / (1 - b) of it to any host, since each
    further k + 1 rounds add at most b times what the k + 1 before them did.
    The end is where no path goes on, or no host's verdict can turn by that much.
    One written table a round cuts the lineage. Each round is two equi-joins on the
    host, which AQE splits where a host has very many links, and one sum with partial
    aggregation.
    """
    kinds = (("trust", "src", "dst", "out_degree"), ("distrust", "dst", "src", "in_degree"))
    sums = [f"{k}{end}" for k, *_ in kinds for end in ("", "_new", "_old")]
    hops = [f"{k}_hop" for k, *_ in kinds]
    out_degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))
    in_degree = links.groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))
    links = materialize(links.join(out_degree, "src").join(in_degree, "dst"), "host-links")
    base = {k: F.expr(f"{k} * {100 - KEEP} / 100") for k, *_ in kinds}
    ranks = materialize(seeds.select("host", *[base[s.split("_")[0]].alias(s) for s in sums], *[F.expr(f"if({k} > 0, 0, null)").alias(f"{k}_hop") for k, *_ in kinds]), "host-ranks")
    equal, done, mark = 0.0, 0, 0
    going = not links.isEmpty()
    while going:
        done, equal = done + 1, EQUAL
        kept = {s: "0D" if s.endswith("_new") else s.replace("_old", "") if mark == done - 1 else s for s in sums}
        grown = ranks.select("host", *[F.expr(kept[s]).alias(s) for s in sums], *hops)
        for kind, at, to, degree in kinds:
            sent = ranks.where(f"{kind}_new > 0 or {kind}_hop = {done - 1}").select(F.col("host").alias(at), f"{kind}_new")
            share = links.join(sent, at).select(F.col(to).alias("host"), F.expr(f"{kind}_new * {KEEP} / (100 * {degree})").alias("share")).withColumn("share", F.expr(f"if(share >= {LEAST_SHARE!r}D, share, 0D)"))
            filled = [F.col("share").alias(s) if s in (kind, f"{kind}_new") else F.lit(0.0).alias(s) for s in sums]
            grown = grown.unionByName(share.select("host", *filled, *[F.lit(done if h == f"{kind}_hop" else None).cast("int").alias(h) for h in hops]))
        before, ranks = ranks, materialize(grown.groupBy("host").agg(*[F.sum(s).alias(s) for s in sums], *[F.min(h).alias(h) for h in hops]), "host-ranks")
        discard(before)
        asked = [F.bool_or(F.expr(" or ".join(f"coalesce({k}_new > 0 or {k}_hop = {done}, false)" for k, *_ in kinds)))]
        for kind, *_ in kinds:
            growth = f"case when {kind}_hop > {mark} then 1D when {kind} = {kind}_old then 0D when {kind}_old > 0 then least({kind} / {kind}_old - 1, 1D) else 1D end"
            asked.append(F.coalesce(F.max(F.expr(growth)), F.lit(0.0)))
        going, *growths = ranks.agg(*asked).first()  # three numbers
        if going and done == 2 * mark + 1:
            mark = done
            if max(growths) < 1:
                more_trust, more_distrust = (b * b / (1 - b) for b in growths)
                turns = f"if(distrust > trust * {1 + equal!r}D, distrust <= trust * {(1 + equal) * (1 + more_trust)!r}D, distrust * {1 + more_distrust!r}D > trust * {1 + equal!r}D)"
                going = max(more_trust, more_distrust) > equal and not ranks.where(f"trust_hop is not null and distrust_hop is not null and {turns}").isEmpty()
    return ranks.select("host", F.expr(f"distrust_hop is not null and (trust_hop is null or distrust > trust * {1 + equal!r}D)").alias("shut"))


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, steps: int | None = STEPS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Without a fitting rule a page is blocked if its host has more distrust than
    trust, after ``steps`` rounds or, with None, as settled; else allowed: also where
    nothing is known of the host, and where links lead to settled ranks that differ by
    less than a part in 10**12. A null URL, and one without ``://``, has an empty host
    and path, which no rule fits. Repeated rows are judged each; null HTML has no
    links; other columns are not read.
    """
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = judged.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    counts = judged.where("found is not null and host <> ''").groupBy("host").agg(F.count_if(F.col("found.verdict") == "allow").alias("allowed"), F.count_if(F.col("found.verdict") == "block").alias("blocked"))
    counts = materialize(counts, "host-seeds")
    all_allowed, all_blocked = counts.agg(F.sum("allowed"), F.sum("blocked")).first()  # two numbers
    whole = "{0} / {2} * {1!r}D" if steps is None else "cast({0} as decimal(19, 0)) * cast({1} as decimal(13, 0)) div cast({2} as decimal(19, 0))"
    scale = WHOLE if steps is None else SCALE
    seeds = materialize(counts.select("host", F.expr(whole.format("allowed", scale, all_allowed or 1)).alias("trust"), F.expr(whole.format("blocked", scale, all_blocked or 1)).alias("distrust")), "host-start")
    links = materialize(host_links(pages, url_col, html_col), "host-pairs")
    ranks = settle(seeds, links).where("shut") if steps is None else propagate(seeds, links, steps).where("distrust > trust")
    shut = materialize(ranks.select("host", F.lit(True).alias("shut")), "host-shut")
    verdict = F.coalesce("found.verdict", F.when(F.col("shut"), "block").otherwise("allow"))
    return judged.join(small_side(shut), "host", "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def _sql() -> str:
    fits = []
    for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        at, slash, rest = rule.partition("/")
        fits.append((f"(host = '{at}' OR suffix(host, '.{at}')) AND starts_with(path, '{slash + rest}')", rule, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in fits) + " END"
    link = LINK.replace("'", "''")
    rounds = [
        f"""r{i + 1} AS (SELECT host, sum(trust)::BIGINT AS trust, sum(distrust)::BIGINT AS distrust FROM (
  SELECT host, trust * {100 - KEEP} // 100 AS trust, distrust * {100 - KEEP} // 100 AS distrust FROM r0
  UNION ALL SELECT dst, (trust * {KEEP} // 100) // od, 0 FROM links JOIN r{i} ON src = host
  UNION ALL SELECT src, 0, (distrust * {KEEP} // 100) // idg FROM links JOIN r{i} ON dst = host) GROUP BY host)"""
        for i in range(STEPS)
    ]
    low = lambda c: f"translate({c}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH parsed AS (
  SELECT page_id, html, coalesce({low(f"regexp_extract(url, '{HOST}', 1)")}, '') AS host, coalesce(regexp_extract(url, '{PATH}', 1), '') AS path FROM pages),
judged AS (SELECT *, {case(1)} AS rule, {case(2)} AS given FROM parsed),
counts AS (SELECT host, count(*) FILTER (WHERE given = 'allow') AS a, count(*) FILTER (WHERE given = 'block') AS b
  FROM judged WHERE rule IS NOT NULL AND host <> '' GROUP BY host),
r0 AS (SELECT host, (a::HUGEINT * {SCALE} // greatest(sum(a) OVER (), 1))::BIGINT AS trust, (b::HUGEINT * {SCALE} // greatest(sum(b) OVER (), 1))::BIGINT AS distrust FROM counts),
pairs AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, {low("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM parsed) WHERE src <> dst AND src <> '' AND dst <> ''),
links AS (SELECT *, count(*) OVER (PARTITION BY src) AS od, count(*) OVER (PARTITION BY dst) AS idg FROM pairs),
{", ".join(rounds)}
SELECT page_id, j.host, path, rule, coalesce(given, CASE WHEN r.distrust > r.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN r{STEPS} r ON r.host = j.host
"""


URL_SQL = _sql()
