"""URL filters by rules and by a tree of path templates, in built-in functions only.

Rules come first: one fits its host and all subdomains if the path starts with the rule's path, and the longest wins.
Other URLs go by the tree. Paths are cut into segments, runs of digits become <n>, and equal (host, path shape) rows are
summed at once. From the root on, per host and parent branch: a parent with many children, few of them frequent, is variable,
and its rare children become the wildcard *, but for those whose labels differ from the other rare ones' (two proportions,
with correction for small counts); the branches under a parent, ordered by smoothed share of bad labels, are merged with
their neighbour unless a two-proportion test tells them apart. Segments that all paths of a branch share are passed at once,
and a path that is alone in its branch is done, so the rounds follow the branching, not the length of paths, and no depth is cut.
A template's purity is its share of bad labels, smoothed towards its host's, which is smoothed towards all; templates at or
above `reject` are blocked.

Shuffles carry one row per (host, shape) after partial sums, or pages with their hot keys dealt into parts; the only
windows run over the branches left under one parent, a few numbers each.

Defined results: null URL or one without :// has empty host and path, and the verdict of the empty host's template; ids may
repeat or be null (a row each); pages without a label don't count in purity; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise("")


def by_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule, as host + path, and its verdict; null without one. Ties: the longer host, then the earlier rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Segments of a path, runs of digits as <n>."""
    return F.split(F.regexp_replace(path, "[0-9]+", "<n>"), "/", -1)


def _tail(parts: Column, n: int | Column) -> Column:
    """An array without its first n entries."""
    return F.slice(parts, F.lit(n) + 1, F.greatest(F.size(parts) - n, F.lit(0)))


def _shared(low: Column, high: Column) -> Column:
    """The entries that two arrays, and so all between them, begin with."""
    differs = F.array_position(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(low.isNull(), F.array().cast("array<string>")).when(differs == 0, low).otherwise(F.slice(low, 1, (differs - 1).cast("int")))


def branches(rows: DataFrame, most_children: int, frequent: float, z2: float, rare_z2: float) -> DataFrame:
    """(host, at, seg, name, shared, n): the branch each segment under `at` belongs to, and the segments all its paths go on with.

    rows: host, at, rest (segments still to come, not empty), n, good, bad.
    """
    after = F.when(F.size("rest") > 1, _tail(F.col("rest"), 1))
    sums = [F.sum(c).cast("double").alias(c) for c in ("n", "good", "bad")]
    children = rows.groupBy("host", "at", F.get("rest", F.lit(0)).alias("seg")).agg(*sums, F.min(after).alias("low"), F.max(after).alias("high"), F.count("*").alias("shapes"))
    key = ["host", "at"]
    parents = children.groupBy(*key).agg(F.count("*").alias("kinds"), F.sum("n").alias("total"))
    fan = parents.select(*key, F.col("kinds").alias("n"))
    children = spread_join(children, parents, key, fan, ["seg"])
    children = children.withColumn("rare", (F.col("kinds") > most_children) & (F.col("n") < frequent * F.col("total")))
    pool = children.groupBy(*key).agg(*(F.coalesce(F.sum(F.when(F.col("rare"), F.col(c))), F.lit(0.0)).alias(f"pool_{c}") for c in ("good", "bad")))
    children = spread_join(children, pool, key, fan, ["seg"])
    g, b = F.col("good"), F.col("bad")
    g0, b0 = F.col("pool_good") - g, F.col("pool_bad") - b
    every = g + b + g0 + b0
    cross = F.greatest(F.abs(b * g0 - b0 * g) - every / 2, F.lit(0.0))
    own = every * cross * cross > F.lit(rare_z2) * (g + b) * (g0 + b0) * (b + b0) * (g + g0)
    children = children.withColumn("branch", F.when(F.col("rare") & ~own, "*").otherwise(F.col("seg"))).select(*key, "seg", "branch", "good", "bad", "low", "high", "shapes")
    left = children.groupBy(*key, "branch").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("kinds"))
    # neighbours by smoothed share of bad labels; a break where the two proportions differ (z squared above z2)
    by = Window.partitionBy(*key).orderBy((F.col("b") + 1) / (F.col("g") + F.col("b") + 2), "branch")
    g0, b0 = F.lag("g").over(by), F.lag("b").over(by)
    n1, n0 = F.col("g") + F.col("b"), g0 + b0
    cross = F.col("b") * n0 - b0 * n1
    apart = cross * cross * (n1 + n0) > F.lit(z2) * n1 * n0 * (F.col("b") + b0) * (F.col("g") + g0)
    left = left.withColumn("set", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(by))
    of = Window.partitionBy(*key, "set")
    left = left.select(*key, "branch", "kinds", F.min("branch").over(of).alias("first"), F.count("*").over(of).alias("size"), _shared(F.min("low").over(of), F.max("high").over(of)).alias("shared"))
    name = F.when(F.col("size") > 1, F.concat("first", F.lit("+"), F.col("size") - 1)).otherwise(F.col("first"))
    names = left.select(*key, "branch", name.alias("name"), "shared")
    named = spread_join(children, names, [*key, "branch"], left.select(*key, "branch", F.col("kinds").alias("n")), ["seg"])
    return named.select(*key, "seg", "name", "shared", F.col("shapes").alias("n"))


def templates(shapes: DataFrame, most_children: int = 16, frequent: float = 0.05, z2: float = 3.84, rare_z2: float = 10.83) -> DataFrame:
    """shapes (host, parts, n, good, bad) with the column `template`: the merged branches from the root to the end of each path."""
    columns = ["host", "parts", "n", "good", "bad"]
    rows, done = shapes.withColumn("at", F.lit("")).withColumn("rest", F.col("parts")), []
    while rows.limit(1).count():
        step = scratch(branches(rows, most_children, frequent, z2, rare_z2), "url-branches")
        key = ["host", "at", "seg"]
        met = spread_join(rows.withColumn("seg", F.get("rest", F.lit(0))), step.drop("n"), key, step.select(*key, "n"), ["parts"])
        # a template keeps to the longest prefix that all its paths share, unless one of them ends within it
        passed = F.least(F.size("shared"), F.size("rest") - 1)
        at = F.concat_ws("/", "at", "name", F.when(F.size("shared") > 0, F.array_join("shared", "/")))
        ends = F.size("rest") == 1
        tree = met.select(*columns, F.when(ends, F.concat_ws("/", "at", "name")).otherwise(at).alias("at"), F.when(ends, F.array().cast("array<string>")).otherwise(_tail(F.col("rest"), 1 + passed)).alias("rest"))
        tree = scratch(tree, "url-tree")
        discard(step)
        done.append(tree.where(F.size("rest") == 0).select(*columns, "at"))
        rows = tree.where(F.size("rest") > 0)
    out = shapes.limit(0).withColumn("at", F.lit(""))
    for part in done:
        out = out.unionByName(part)
    return out.withColumnRenamed("at", "template")


def judged(pages: DataFrame, labels: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", weight: float = 4.0, reject: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each page. labels: page_id and bad (0 or 1, null is unlabelled), at most a row each id."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    label = labels.select("page_id", "bad").groupBy("page_id").agg(F.max("bad").alias("bad"))
    shaped = rows.select("page_id", "host", segments(F.col("path")).alias("parts"))
    one = lambda k: F.coalesce(F.sum(F.when(F.col("bad") == k, 1)), F.lit(0)).alias(("good", "bad")[k])
    shapes = shaped.join(label, "page_id", "left").groupBy("host", "parts").agg(F.count("*").alias("n"), one(0), one(1))
    shapes = scratch(shapes, "url-shapes")
    tree = scratch(templates(shapes), "url-templates")
    all_good, all_bad = (x or 0 for x in shapes.agg(F.sum("good"), F.sum("bad")).first())
    rate = F.lit((all_bad + 1) / (all_good + all_bad + 2))
    hosts = shapes.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).select("host", ((F.col("b") + weight * rate) / (F.col("g") + F.col("b") + weight)).alias("host_rate"))
    sums = tree.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).join(hosts, "host")
    purity = sums.select("host", "template", ((F.col("b") + weight * F.col("host_rate")) / (F.col("g") + F.col("b") + weight)).alias("purity"))
    shaped_in = tree.groupBy("host", "template").agg(F.count("*").alias("n"))
    verdicts = spread_join(tree.select("host", "parts", "template"), purity, ["host", "template"], shaped_in, ["parts"])
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    out = spread_join(rows.withColumn("parts", segments(F.col("path"))), verdicts, ["host", "parts"], shapes.select("host", "parts", "n"), ["page_id"])
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def oracle(rules: list[Rule], bad: str, weight: float = 4.0, reject: float = 0.5, levels: int = 8, most_children: int = 16, frequent: float = 0.05, z2: float = 3.84, rare_z2: float = 10.83) -> str:
    """The same over `pages` as DuckDB SQL for paths of up to `levels` segments, one level after the other; bad: a query of page_id and bad."""
    cases = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in cases) + " end"
    verdict = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in cases) + " end"
    steps = []
    for k in range(1, levels + 1):
        steps.append(f"""here{k} as (select *, parts[{k}] as seg from tree{k - 1}),
    child{k} as (select host, spot, seg, sum(n)::double as n, sum(good)::double as good, sum(bad)::double as bad from here{k} where seg is not null group by host, spot, seg),
    rare{k} as (select *, count(*) over w > {most_children} and n < {frequent} * sum(n) over w as rare from child{k} window w as (partition by host, spot)),
    pool{k} as (select *, coalesce(sum(good) filter (rare) over w, 0) - good as g0, coalesce(sum(bad) filter (rare) over w, 0) - bad as b0 from rare{k} window w as (partition by host, spot)),
    own{k} as (select *, greatest(abs(bad * g0 - b0 * good) - (good + bad + g0 + b0) / 2, 0) as c from pool{k}),
    branch{k} as (select *, case when rare and not (good + bad + g0 + b0) * c * c > {rare_z2} * (good + bad) * (g0 + b0) * (bad + b0) * (good + g0) then '*' else seg end as branch from own{k}),
    sum{k} as (select host, spot, branch, sum(good) as g, sum(bad) as b from branch{k} group by host, spot, branch),
    lag{k} as (select *, lag(g) over w as g0, lag(b) over w as b0, (b + 1) / (g + b + 2) as share from sum{k} window w as (partition by host, spot order by (b + 1) / (g + b + 2), branch)),
    apart{k} as (select *, coalesce(pow(b * (g0 + b0) - b0 * (g + b), 2) * (g + b + g0 + b0) > {z2} * (g + b) * (g0 + b0) * (b + b0) * (g + g0), false)::int as apart from lag{k}),
    group{k} as (select *, sum(apart) over (partition by host, spot order by share, branch) as grp from apart{k}),
    name{k} as (select host, spot, branch, case when count(*) over v > 1 then min(branch) over v || '+' || (count(*) over v - 1) else min(branch) over v end as name from group{k} window v as (partition by host, spot, grp)),
    tree{k} as (select h.host, h.parts, h.n, h.good, h.bad, case when name is null then h.spot else h.spot || '/' || name end as spot
      from here{k} h left join (select host, spot, seg, name from branch{k} join name{k} using (host, spot, branch)) x on x.host = h.host and x.spot = h.spot and x.seg = h.seg)""")
    return f"""with label as (select page_id, max(bad) as bad from ({bad}) group by 1),
    cut as (select page_id, case when contains(url, '://') then translate(regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*'), '{UPPER}', '{LOWER}') else '' end as host,
      case when contains(url, '://') then regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*([^?#]*)', 1) else '' end as path from pages),
    page as (select *, string_split(regexp_replace(path, '[0-9]+', '<n>', 'g'), '/') as parts from cut),
    tree0 as (select host, parts, count(*) as n, count(*) filter (bad = 0) as good, count(*) filter (bad = 1) as bad, '' as spot from page left join label using (page_id) group by host, parts),
    {", ".join(steps)},
    rate as (select (sum(bad) + 1)::double / (sum(good) + sum(bad) + 2) as r from tree0),
    host as (select host, (sum(bad) + {weight} * (select r from rate)) / (sum(good) + sum(bad) + {weight}) as host_rate from tree0 group by host),
    pure as (select host, spot, (sum(bad) + {weight} * any_value(host_rate)) / (sum(good) + sum(bad) + {weight}) as purity from tree{levels} join host using (host) group by host, spot)
    select page_id, host, path, {rule} as rule, coalesce({verdict}, case when purity >= {reject} then 'block' else 'allow' end) as verdict, spot as template, round(purity, 6) as purity
    from page join (select host, parts, spot, purity from tree{levels} join pure using (host, spot)) using (host, parts)"""
