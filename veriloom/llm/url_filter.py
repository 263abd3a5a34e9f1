"""URL filter: prefix rules, else the likelihood ratio of two character models.

Two variable-order Markov models, one of accepted and one of rejected URLs, give each character its probability after the
characters before it.  Orders 0 to ``ORDER`` are interpolated: an order's estimate is smoothed towards the next lower one in
proportion to ``PRIOR``, down to a uniform start.  A URL's score is the difference of the log-likelihoods divided by its length; it
is allowed from a threshold on that separates the labelled URLs of a calibration fold best.  The labelled URLs are those that a
rule decides: every fifth by a digest of the URL calibrates, the rest train.

Characters are folded to ``ALPHABET`` symbols, so the models have at most ``len(ALPHABET) ** (ORDER + 1)`` rows whatever the
number of pages: that is the proven bound of the one table that is broadcast.  All counts cover all pages.  Distinct URLs are
scored, so a URL that a third of all pages share is scored once.  Everything is DataFrame functions.

Rules look at host and path; the models read the whole URL after ``://`` (all of it where there is none), query and fragment too.

Defined results: null, empty and ``://``-less URLs have empty host and path and no rule; null and empty ones have score 0; without
training URLs of both kinds every score is 0, and without calibration URLs of both kinds the threshold is 0, so the method then
allows; a very long URL is scored whole; equal URLs get equal verdicts, rows that repeat too; other columns, whatever their names,
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: (host, path, verdict); a rule fits its host and all subdomains, the longest wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

ORDER = 3
PRIOR = 4.0
#: Symbols; digits are folded to 0 and all else to the last.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_?=&%~"
#: Thresholds tried, on either side of 0.
STEPS, STEP = 200, 0.005


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, decision in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def folded(url: Column) -> Column:
    """The whole URL without its scheme, in the models' alphabet."""
    url = F.coalesce(url, F.lit(""))
    whole = F.when(F.instr(url, "://") > 0, _after_scheme(url)).otherwise(url)
    return F.regexp_replace(F.translate(_lower(whole), "123456789", "000000000"), "[^a-z0/.\\-_?=&%]", "~")


def grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``urls`` with ``gram``: each character with up to ``order`` characters before it (``^`` stands before the first)."""
    padded = F.concat(F.lit("^" * order), F.col("folded"))
    return urls.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length("folded")), lambda i: F.substr(padded, i, F.lit(order + 1)))))


def train(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, ratio``: log P(last character | the others) of the accepted less that of the rejected; 0 if a kind is missing.

    ``labelled`` has ``folded, accepted, n``: distinct URLs and the pages that have them.
    """
    full = grams(labelled.filter("length(folded) > 0"), order).groupBy("gram").agg(
        F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("no")
    )
    full = written(full, "url-grams")
    table = None
    uniform = 1.0 / (len(ALPHABET) + 1)
    for k in range(order + 1):
        # counts of the last k + 1 characters, and of the k before the last
        some = full.groupBy(F.substr("gram", F.lit(order + 1 - k)).alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        some = some.withColumn("context", F.substr("gram", F.lit(1), F.lit(k)))
        context = some.groupBy("context").agg(F.sum("yes").alias("yes_all"), F.sum("no").alias("no_all"))
        some = some.join(context, "context")
        if table is None:
            some = some.withColumns({"p": F.lit(uniform), "q": F.lit(uniform), "both": (F.col("yes_all") > 0) & (F.col("no_all") > 0)})
        else:
            lower = table.select(F.col("gram").alias("lower"), "p", "q", "both")
            some = some.join(lower, F.substr(some["gram"], F.lit(2)) == F.col("lower")).drop("lower")
        p = (F.col("yes") + F.lit(PRIOR) * F.col("p")) / (F.col("yes_all") + F.lit(PRIOR))
        q = (F.col("no") + F.lit(PRIOR) * F.col("q")) / (F.col("no_all") + F.lit(PRIOR))
        table = some.select("gram", p.alias("p"), q.alias("q"), "both")
    return table.select("gram", F.when(F.col("both"), F.log(F.col("p") / F.col("q"))).otherwise(F.lit(0.0)).alias("ratio"))


def scored(urls: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``url, score`` of distinct ``urls(url, folded)``; grams that no labelled URL has count 0."""
    rows = grams(urls.select("url", "folded").filter("length(folded) > 0"), order)
    rows = rows.join(F.broadcast(model), "gram", "left")
    total = rows.groupBy("url").agg((F.sum(F.coalesce("ratio", F.lit(0.0))) / F.count(F.lit(1))).alias("score"))
    return total.withColumn("score", F.round("score", 9))  # sums in any order agree


def threshold(calibration: DataFrame) -> DataFrame:
    """One row ``threshold``: of the steps the one with the most pages of ``calibration(score, accepted, n)`` right, each kind
    weighing the same; of equals the one nearest to 0, then the larger."""
    cell = F.greatest(F.lit(-STEPS - 1), F.least(F.lit(STEPS), F.floor(F.round(F.col("score") / STEP, 6)))).cast("int")
    some = calibration.groupBy(cell.alias("cell")).agg(
        F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("no")
    )  # at most 2 x STEPS + 2 rows
    steps = calibration.sparkSession.range(-STEPS, STEPS + 1).select(F.col("id").cast("int").alias("cell"), F.lit(0).alias("yes"), F.lit(0).alias("no"))
    order = Window.orderBy("cell", F.col("step").asc_nulls_last())
    both = steps.withColumn("step", F.col("cell")).unionByName(some, allowMissingColumns=True).withColumns({
        "yes_all": F.sum("yes").over(Window.partitionBy()), "no_all": F.sum("no").over(Window.partitionBy()),
        "yes_before": F.sum("yes").over(order), "no_before": F.sum("no").over(order),
    })
    right = both.filter("step is not null").select("step", (F.col("yes_all") - F.col("yes_before")).alias("kept"), F.col("no_before").alias("cut"), F.col("yes_all").alias("yes"), F.col("no_all").alias("no"))
    good = F.round(F.coalesce(F.col("kept") / F.col("yes"), F.lit(0.0)) + F.coalesce(F.col("cut") / F.col("no"), F.lit(0.0)), 9)
    best = F.max(F.struct(F.when(F.col("yes") * F.col("no") > 0, good).otherwise(F.lit(0.0)).alias("good"), (-F.abs("step")).alias("near"), "step"))
    return right.agg(best.alias("best")).select((F.col("best.step") * F.lit(STEP)).alias("threshold"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, score, verdict`` of every page."""
    urls = pages.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "decided": decided, "folded": folded(F.col("url"))})
    urls = written(urls.withColumn("fold", F.conv(F.substr(F.md5(F.coalesce("url", F.lit("")).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % 5), "urls")
    labelled = urls.filter("rule is not null").withColumn("accepted", F.col("decided") == "allow")
    model = written(train(labelled.filter("fold <> 0")), "url-model")
    scores = written(scored(urls, model), "url-scores")
    line = threshold(labelled.filter("fold = 0").join(scores, "url")).first()["threshold"]  # one number
    method = F.when(F.col("score") >= F.lit(line), "allow").otherwise("block")
    named = urls.join(scores, "url", "left").na.fill(0.0, ["score"])
    known = F.coalesce(F.col("url"), F.lit(""))
    named = named.select(known.alias("__url"), F.col("url").isNull().alias("__none"), "host", "path", "rule", "score", F.coalesce("decided", method).alias("verdict"))
    named = written(named, "url-verdicts")
    # one row per URL meets its pages; the hot side is split by adaptive skew handling
    rows = pages.select(F.col("page_id").alias("page_id"), known.alias("__url"), F.col("url").isNull().alias("__none"))
    return rows.join(named, ["__url", "__none"]).select("page_id", "host", "path", "rule", "score", "verdict")


def _oracle() -> str:
    orders = []
    for k in range(ORDER + 1):
        lower = f"JOIN p{k - 1} b ON b.gram = substr(a.gram, 2)" if k else ""
        p, q = ("b.p", "b.q") if k else (f"CAST(1.0 AS DOUBLE) / {len(ALPHABET) + 1}",) * 2
        orders.append(f"""
c{k} AS (SELECT substr(gram, {ORDER + 1 - k}) AS gram, sum(yes) AS yes, sum(no) AS no FROM g GROUP BY 1),
a{k} AS (SELECT left(gram, {k}) AS context, sum(yes) AS yes_all, sum(no) AS no_all FROM c{k} GROUP BY 1),
p{k} AS (SELECT a.gram, (a.yes + {PRIOR} * {p}) / (t.yes_all + {PRIOR}) AS p, (a.no + {PRIOR} * {q}) / (t.no_all + {PRIOR}) AS q
  FROM c{k} a JOIN a{k} t ON t.context = left(a.gram, {k}) {lower}),""")
    return f"""
WITH s AS (
  SELECT url, count(*) AS n, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest,
    CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE coalesce(url, '') END AS whole FROM pages GROUP BY url
), u AS (
  SELECT url, n, whole, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s
), l AS (
  SELECT *, CASE WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/' WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
    regexp_replace(translate(whole, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^a-z0/.\\-_?=&%]', '~', 'g') AS folded,
    CAST('0x' || left(md5(coalesce(url, '')), 8) AS BIGINT) % 5 AS fold FROM u
), d AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS decided FROM l
), x AS (
  SELECT url, decided, fold, n, unnest(list_transform(range(1, length(folded) + 1), lambda i: substr(repeat('^', {ORDER}) || folded, i, {ORDER + 1}))) AS gram FROM d
), g AS (
  SELECT gram, sum(CASE WHEN decided = 'allow' THEN n ELSE 0 END) AS yes, sum(CASE WHEN decided = 'block' THEN n ELSE 0 END) AS no
  FROM x WHERE decided IS NOT NULL AND fold <> 0 GROUP BY gram
),{"".join(orders)}
z AS (
  SELECT url, round(sum(CASE WHEN (SELECT yes_all > 0 AND no_all > 0 FROM a0) THEN coalesce(ln(p / q), 0) ELSE 0 END) / count(*), 9) AS score FROM x LEFT JOIN p{ORDER} USING (gram) GROUP BY url
), k AS (
  SELECT greatest({-STEPS - 1}, least({STEPS}, floor(round(score / {STEP}, 6)))) AS cell, decided = 'allow' AS yes, n FROM d JOIN z USING (url) WHERE decided IS NOT NULL AND fold = 0
), w AS (
  SELECT step, round(sum(CASE WHEN yes AND cell >= step THEN n ELSE 0 END) / sum(CASE WHEN yes THEN n ELSE 0 END)
    + sum(CASE WHEN NOT yes AND cell < step THEN n ELSE 0 END) / sum(CASE WHEN NOT yes THEN n ELSE 0 END), 9) AS good
  FROM k, range({-STEPS}, {STEPS + 1}) r(step) GROUP BY step
), t AS (SELECT step * {STEP} AS line FROM w ORDER BY good DESC, abs(step), step DESC LIMIT 1)
SELECT page_id, host, path, rule, coalesce(score, 0) AS score, coalesce(decided, CASE WHEN coalesce(score, 0) >= (SELECT line FROM t) THEN 'allow' ELSE 'block' END) AS verdict
FROM pages JOIN d ON pages.url IS NOT DISTINCT FROM d.url LEFT JOIN z ON pages.url = z.url
"""


ORACLE_SQL = _oracle()
