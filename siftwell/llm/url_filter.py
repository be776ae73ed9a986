"""URL verdicts by rules and, where no rule fits, by gradient-boosted trees on lexical features (DataFrame operations only).

The trees are fitted on a bounded sample of labelled URLs and written out as one SQL expression, so scoring stays in
generated code. Suffix statistics are the smoothed block rates of a host's last label and last two labels in the sample.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.scratch import Scratch

#: Labelled URLs read by the fit, and suffixes kept of them (those with most URLs).
SAMPLE, SUFFIXES = 20_000, 200
TREES, DEPTH, SEED = 12, 3, 7
#: URLs of the average mix that each suffix is taken to have besides its own.
PRIOR = 5.0


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    under = (F.col("host") == host) | F.col("host").endswith(F.lit("." + host))
    return under & F.col("path").startswith(F.lit(slash + path))


def with_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """urls with host, path, rule and rule_verdict. rules: (verdict, host/path); of those that fit the longest wins.

    The rules are a bounded list, tried in one expression from the longest down. A url that is null or has no "://" has
    an empty host and path, which fit no rule. Columns of these four names are replaced."""
    base = urls.drop("host", "path", "rule", "rule_verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the last one wraps all before it
        rule, verdict = F.when(_fits(r), F.lit(r)).otherwise(rule), F.when(_fits(r), F.lit(v)).otherwise(verdict)
    return base.withColumns({"rule": rule, "rule_verdict": verdict})


def _entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of the characters; 0 for an empty text."""
    n = F.length(text)
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """urls (with url, host, path) and f, an array of the lexical features, and the two suffixes s1 and s2 of the host."""
    url = F.coalesce("url", F.lit(""))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    features = [
        F.length(url).cast("double"),
        F.length("host").cast("double"),
        F.length("path").cast("double"),
        count(F.col("path"), "/[^/]"),
        count(F.col("host"), r"\."),
        count(url, "[0-9]") / size,
        count(F.col("host"), "[0-9-]"),
        count(url, "[^A-Za-z0-9]") / size,
        _entropy(F.col("host")),
        _entropy(F.col("path")),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0),
        url.startswith("https://").cast("double"),
    ]
    return urls.withColumns({"f": F.array(*features), "s1": F.substring_index("host", ".", -1), "s2": F.substring_index("host", ".", -2)})


def _rates(sample: DataFrame) -> tuple[float, dict[str, dict[str, float]]]:
    """The share of block labels, and the smoothed share of the commonest suffixes."""
    n, k = sample.agg(F.count("*"), F.sum("label")).first()
    base = k / n
    out = {}
    for s in ("s1", "s2"):
        rows = sample.groupBy(s).agg(F.count("*").alias("n"), F.sum("label").alias("k")).orderBy(F.desc("n"), s).limit(SUFFIXES).collect()
        out[s] = {r[s]: (r["k"] + PRIOR * base) / (r["n"] + PRIOR) for r in rows}
    return base, out


def _with_rates(urls: DataFrame, base: float, rates: dict[str, dict[str, float]]) -> DataFrame:
    looked = [F.coalesce(F.try_element_at(_literal_map(rates[s]), F.col(s)), F.lit(base)) for s in ("s1", "s2")]
    return urls.withColumn("f", F.concat("f", F.array(*looked)))


def _literal_map(values: dict[str, float]) -> Column:
    keys, rates = F.array(*[F.lit(k) for k in values]), F.array(*[F.lit(v) for v in values.values()])
    return F.map_from_arrays(keys, rates)


def _tree_sql(text: str) -> str:
    """A fitted tree, as it describes itself, as a CASE expression over f."""
    lines = [x for x in text.splitlines()[1:] if x.strip()]

    def parse(i: int) -> tuple[str, int]:
        line = lines[i].strip()
        if m := re.match(r"Predict: (\S+)", line):
            return f"{float(m[1])!r}D", i + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        yes, i = parse(i + 1)
        no, i = parse(i + 1)  # past the line of Else
        return f"CASE WHEN f[{m[1]}] <= {float(m[2])!r}D THEN {yes} ELSE {no} END", i

    return parse(0)[0]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[float, dict, str] | None:
    """labelled (url, host, path, label 0/1): block rate, suffix rates and the trees' margin as SQL. None unless there are
    labels of both kinds. At most `sample` distinct URLs are read, those whose hashes are lowest."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    few = labelled.select("url", "host", "path", F.col("label").cast("double").alias("label")).distinct()
    few = lexical(few.orderBy(F.xxhash64("url"), "url", "label").limit(sample))
    few = Scratch(labelled.sparkSession).keep(few.select("f", "s1", "s2", "label"), "labelled")
    if few.select("label").distinct().count() < 2:
        return None
    base, rates = _rates(few)
    train = _with_rates(few, base, rates).select(array_to_vector("f").alias("features"), "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1).fit(train.coalesce(4))
    margin = " + ".join(f"{w!r}D * ({_tree_sql(t.toDebugString)})" for w, t in zip(model.treeWeights, model.trees, strict=True))
    return base, rates, margin


def judge(urls: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """urls with host, path, rule and verdict: block or allow, by the longest rule, else by the trees.

    labelled: (url, label), 1 for URLs to block; without it the URLs that a rule decides are the labelled ones. Where no trees can be fitted
    (no labels, or of one kind only) URLs without a rule are allowed. Null, empty and malformed URLs have an empty host and
    path and go to the trees like all others. Repeated rows get equal verdicts. Columns of these four names are replaced.
    """
    ruled = with_rules(urls.drop("verdict"), rules)
    if labelled is None:
        labelled = ruled.filter("rule is not null").select("url", "host", "path", (F.col("rule_verdict") == "block").cast("int").alias("label"))
    else:
        labelled = labelled.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label").filter("label is not null")
    model = fit(labelled)
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    if model is None:
        shown = ruled.withColumn("margin", F.lit(0.0))
    else:
        base, rates, margin = model
        # In two steps, so that the features are computed once and then tested by the trees.
        shown = _with_rates(lexical(ruled), base, rates).withColumn("margin", F.expr(margin))
    verdict = F.coalesce("rule_verdict", F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return shown.select(*names, "host", "path", "rule", verdict.alias("verdict"))
