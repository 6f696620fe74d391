"""URL filters: rules on hosts and paths, and for what no rule fits a logistic regression on hashed character n-grams.

Host and path are cut into character n-grams, hashed into a fixed number of buckets, as native expressions over the
row's own URL, so nothing is shuffled. The regression learns from a small labelled table by full gradient steps, each of
them one aggregate over the table's n-grams; its weights enter the plan as one constant array."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsift.llm.common import first_by_hash, materialize

#: Names of sites, as block and allow lists have them, that the default table is made of.
BLOCKED_NAMES = """casino poker-room slots jackpot-city roulette-online betting best-bets sportsbook lottery-win free-spins blackjack-live bet-now winbig
viagra-shop cialis pills-online cheap-meds pharmacy-rx diet-pills weightloss-now adult-videos porn xxx-tube sex-chat nude-cams escort-girls hot-singles adult-dating camgirls
adserver ads-network ad-banner popunder click-track trackers ad-clicks affiliate-track pixel-track tracking-ads spam link-farm spam-mailer seo-backlinks content-farm
replica-watches cheap-replica payday-loans fast-loans free-money free-gift prize-winner win-prizes get-rich free-iphone cheap-tickets-free warez crack-keygen malware-download phishing-login verify-account""".split()
ALLOWED_NAMES = """news daily-herald times-online morning-post university faculty-of-arts library museum archive science-today journal weather school hospital garden-club travel-notes recipes kitchen
history-society maps bookshop music-review city-council county-records parliament forum docs wiki myblog python-tutorials linux-help astronomy physics chemistry biology medicine-journal philosophy theatre
cinema-review football-club running cycling hiking-trails photography painting architecture furniture carpentry train-timetable airport harbour fishing farming bakery coffee-roasters tea-house
community-center neighbours parents-association teachers-union engineers statistics mathematics geology oceans forests wildlife birds orchestra choir language-school translation dictionary encyclopedia
standards open-data software-foundation conference proceedings thesis research-institute laboratory observatory foundation charity volunteers water-works energy transport public-health""".split()
_PREFIXES = ("", "www.", "m.", "blog.", "shop.")
_ENDS = (".example.com", ".org", ".net", ".example.org", ".com", ".example.net", ".info")
_PATHS = ("/en/12045", "/", "/de/771.html", "/2021/05/31/title", "/fr/390/", "", "/index.php", "/es/8812", "/articles/long-title-of-a-page", "/a/b/c.html", "/en/about")

SIZES = (3, 4, 5)
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Names that say nothing: made of syllables by a rule, as most hosts' names are to a model that has never seen them.
_SYLLABLES = "an be cor del er fin gar hel in jo kar lem mor nat ol pre quin ran ser ting thor ul ver wil zen the ion".split()


def default_table(spark: SparkSession) -> DataFrame:
    """(url, label): the fixed names, and as many made-up ones to be allowed as there are to be blocked, each as several
    URLs, 1 to be blocked. Prefix, end and path go round, so that they tell little about the label."""
    k = len(_SYLLABLES)
    made = ["".join(_SYLLABLES[(i * step + shift) % k] for step, shift in ((1, 0), (5, 3), (11, 7))[: 2 + i % 2]) for i in range(len(BLOCKED_NAMES))]
    urls = []
    for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES), (0, made)):
        for i, name in enumerate(names):
            for j in (i, i + 3, i + 5):
                urls.append(f"('https://{_PREFIXES[j % len(_PREFIXES)]}{name}{_ENDS[j % len(_ENDS)]}{_PATHS[j % len(_PATHS)]}', {label})")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(urls)} AS t(url, label)")


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, its A-Z lower-cased; '' if there is no '://'."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; '' if there is no '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ('host/path', verdict) that fits, null if none does. A rule fits its host and
    all subdomains, if the path starts with its own; of equally long ones the first in ASCII order wins."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(text: Column, part: int, buckets: int) -> Column:
    """array<int>: the buckets of all n-grams of ``text`` between marks of its begin and end, repeats included; none of an
    empty text. ``part`` keeps hosts and paths apart."""
    chars = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda x: x != "")
    none = F.array().cast("array<int>")

    def sized(c: Column, n: int) -> Column:
        one = lambda i: F.pmod(F.xxhash64(F.lit(part), *[F.get(c, i + k) for k in range(n)]), F.lit(buckets)).cast("int")
        return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), one)).otherwise(none)

    every = F.get(F.transform(F.array(chars), lambda c: F.concat(*[sized(c, n) for n in SIZES])), F.lit(0))
    return F.when(F.length(text) > 0, every).otherwise(none)


class UrlModel:
    """``weights`` of the buckets and the ``bias``. The margin of a URL is the bias and, for host and path each, the sum
    of its n-grams' weights over the root of their number."""

    def __init__(self, weights: list[float], bias: float):
        self.weights, self.bias = weights, bias

    def margin(self, host: Column, path: Column) -> Column:
        w = _constant(self.weights)

        def part(found: Column) -> Column:
            total = F.aggregate(found, F.lit(0.0), lambda a, f: a + F.get(w, f))
            return total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))

        each = [F.get(F.transform(F.array(grams(x, i, len(self.weights))), part), F.lit(0)) for i, x in enumerate((host, path))]
        return F.lit(self.bias) + each[0] + each[1]


def _constant(values: list[float]) -> Column:
    """A constant array<double>, which the optimizer folds to one literal."""
    return F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>")


def fit(table: DataFrame, url_column: str = "url", label_column: str = "label", sample_rows: int = 5000, buckets: int = 1 << 13, rounds: int = 25, rate: float = 1.0, ridge: float = 2e-4) -> UrlModel:
    """Learns from the first ``sample_rows`` distinct URLs of ``table`` in the order of their hash (label 0/1; of a URL with
    both, 1). Null URLs and other labels teach nothing; with one label only, or an empty table, nothing is learnt and every
    margin is -1.0 (or 1.0, if all labels are 1).

    The sample is bounded, so its n-grams stay in one task; each of ``rounds`` full gradient steps is one aggregate over
    them, whose sums, one for each bucket, come to the driver."""
    known = table.where(F.col(label_column).isin(0, 1) & F.col(url_column).isNotNull()).select(F.col(url_column).cast("string").alias("url"), F.col(label_column).cast("double").alias("label"))
    chosen = known.join(F.broadcast(first_by_hash(known, "url", sample_rows)), "url").groupBy("url").agg(F.max("label").alias("label"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    sides = chosen.select("label", F.explode(F.array(F.struct(grams(host, 0, buckets).alias("h"), grams(path, 1, buckets).alias("p")))).alias("g"))
    each = lambda side: F.transform(f"g.{side}", lambda f: F.struct(f.alias("f"), (F.lit(1.0) / F.sqrt(F.size(f"g.{side}").cast("double"))).alias("v")))
    rows = materialize(sides.select("label", F.concat(each("h"), each("p")).alias("x"))).coalesce(1)
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return UrlModel([0.0] * buckets, 1.0 if n and ones == n else -1.0)
    w, bias = [0.0] * buckets, math.log(ones / (n - ones))
    seen, bias_seen = [1e-6] * buckets, 1e-6  # sums of squared gradients, which set each weight's own rate
    for _ in range(rounds):
        now = _constant(w)
        margin = F.aggregate("x", F.lit(bias), lambda a, e: a + F.get(now, e["f"]) * e["v"])
        off = rows.select((F.lit(1.0) / (1.0 + F.exp(-margin)) - F.col("label")).alias("off"), "x")
        gradient = off.select(F.explode(F.array_append(F.transform("x", lambda e: F.struct(e["f"].alias("f"), (e["v"] * F.col("off")).alias("g"))), F.struct(F.lit(-1).alias("f"), F.col("off").alias("g")))).alias("e"))
        for f, g in gradient.groupBy("e.f").agg(F.sum("e.g")).collect():  # at most as many as buckets
            g /= n
            if f < 0:
                bias_seen += g * g
                bias -= rate * g / math.sqrt(bias_seen)
            else:
                g += ridge * w[f]
                seen[f] += g * g
                w[f] -= rate * g / math.sqrt(seen[f])
    return UrlModel(w, bias)


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id column, host, path, rule, verdict, score): 'allow' or 'block' of each row's URL, by the longest rule that fits,
    else 'block' from a score of 0.5 on. ``score``: the model's probability, null where a rule decides.

    Null URLs and those without '://' have an empty host and path, which no rule fits and whose margin is the model's
    bias; URLs of any length are read whole; rows that repeat are judged each; an empty table gives an empty result; other
    columns, whatever their names, are ignored."""
    url = F.col(url_column).cast("string")
    rows = pages.select(F.col(id_column).alias("id"), F.explode(F.array(F.struct(host_of(url).alias("host"), path_of(url).alias("path")))).alias("u"))
    rule, verdict = rule_of(F.col("u.host"), F.col("u.path"), rules)
    score = F.when(verdict.isNull(), F.lit(1.0) / (1.0 + F.exp(-model.margin(F.col("u.host"), F.col("u.path")))))
    rows = rows.select("id", "u", rule.alias("rule"), F.explode(F.array(F.struct(verdict.alias("verdict"), score.alias("score")))).alias("v"))
    said = F.coalesce(F.col("v.verdict"), F.when(F.col("v.score") >= 0.5, "block").otherwise("allow"))
    return rows.select(F.col("id").alias(id_column), F.col("u.host").alias("host"), F.col("u.path").alias("path"), "rule", said.alias("verdict"), F.col("v.score").alias("score"))
