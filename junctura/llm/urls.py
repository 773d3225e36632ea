"""URL filters: a rule list, and for urls that no rule fits a logistic regression on hashed character n-grams of host and path.

The regression is trained from a small table of labelled urls, built here from words of several kinds of bad site (gambling, adult,
medicines, loans, piracy, fraud, advertising and tracking) and of good ones, on the same neutral hosts, endings and paths, so that
these decide nothing. Its features are the counts of n-grams of three and four characters of the host and, apart from those, of the path,
hashed by a polynomial over code points; weights and bias are fitted by Newton steps on the n-grams that occur. Counts, not shares: a word says
the same on a long host. The model is one weight for each bucket, which the scan reads as a constant array. No row is moved, and all of it is
SQL functions.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: what follows up to ``?``, ``#``
or the end. A rule fits its host and all subdomains where the path starts with the rule's; the longest rule wins.

Defined cases: a null url, or one without ``://``, has an empty host and path, which no rule fits and the regression judges by its
bias alone, allowed; very long urls are judged whole; repeated rows each get a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BUCKETS, GRAMS = 8191, (3, 4)
#: Value of an n-gram each time that it occurs.
UNIT = 0.3
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Words of hosts to block and to allow, by kind. Some share stems, so that a word left out is not wholly unknown.
BAD = {
    "gambling": "casino casinos casinobonus casino-win livecasino poker pokerroom freepoker slots slotgames jackpot jackpots betting bets bestbets betnow onlinebet bingo lottery lotto roulette blackjack freespins spinwin winbig bigwin",
    "adult": "xxx xxxtube porn porntube freeporn adultcams sexcams sexchat freesex nudes nudecams escort escorts hentai camgirls webcamgirls",
    "medicines": "viagra cialis buycialis pills dietpills cheap-pills pillstore pharmacy-cheap cheapmeds buymeds steroids buysteroids slimfast",
    "loans": "payday paydayloan loan-now fastloan quickloan quickcash cashnow fastcash cashadvance creditfix badcredit debtfree debtfix",
    "piracy": "torrent torrents freetorrent warez crack cracked crackz keygen keygens serials fullmovie freemovies nulled pirated",
    "fraud": "replica replicas giveaway freegift freeprize prize-winner prizes clickhere clicknow verify-account account-verify cryptodouble doublecoins",
    "advertising": "ads adsnet bestads ads-media ads-gate ads-link adserver adserve adserv adclick adclicks adnet track tracker trackers tracking adtrack track-it popunder popads banner-ads pixel pixels clicktrack clickads",
}
GOOD = {
    "learning": "university school schools library libraries museum museums science sciences history physics mathematics maths lectures archive archives academy college",
    "news": "news dailynews newspaper daily herald times press weather journal journals magazine review reviews gazette",
    "technology": "docs developer developers python linux software forum forums manual manuals database wiki help helpdesk code opensource",
    "life": "recipes garden gardens gardening travel traveller music cinema football hiking cooking cook family photos photography",
    "public": "government council councils health hospital hospitals parliament court courts transport police cityhall",
    "trade": "books bookshop bookstore furniture bakery hotel hotels restaurant restaurants clothing bicycle bicycles market shop shops",
}


def labelled(words: dict[int, list[str]] | None = None) -> list[tuple[str, str, int]]:
    """(host, path, label), label 1 for urls to block. Each word stands in a few hosts, some with a syllable that says nothing, and in
    a path; hosts and paths without any word are good."""
    words = words or {1: [w for ws in BAD.values() for w in ws.split()], 0: [w for ws in GOOD.values() for w in ws.split()]}
    endings, fronts = ["com", "net", "org", "info", "example.com", "example.net", "example.org"], ["", "www.", "m.", "blog.", "my-", "best-"]
    syllables = ["th", "er", "an", "re", "on", "tion", "ing", "es", "st", "ou", "ha", "ed", "nd", "le", "or"]
    pages = ["/", "/en/1234", "/fr/77.html", "/de/index.html", "/es/4021/", "/about", "/article/5", "/p/90", "/en/512/"]
    rows = []
    for label, own in words.items():
        for i, w in enumerate(own):
            plain = syllables[i % 15] + syllables[(4 * i + 3) % 15]
            for k, host in enumerate((f"{fronts[i % 6]}{w}", f"{fronts[(i + 1) % 4]}{w}-{plain}", f"{fronts[(i + 2) % 4]}{plain}{w}", f"{w}.{plain}")):
                rows.append((f"{host}.{endings[(i + 2 * k) % 7]}", pages[(i + k) % 9], label))
            rows.append((f"{plain}.{endings[i % 7]}", f"/{w}/{17 * i}", label))
    for i in range(3 * 15 * 15):
        host = "".join(syllables[n % 15] for n in (i, i // 15, 7 * i + 2, 11 * i)[: 2 + i % 3])
        rows.append((f"{fronts[i % 4]}{host}.{endings[i % 7]}", (pages[i % 9], f"/{('en', 'fr', 'de', 'es')[i % 4]}/{7919 * i % 10007}{('', '.html', '/')[i % 3]}")[i % 2], 0))
    return rows + [("", "", 0)] * 60  # a url without host says nothing


def _buckets(text: str, side: int) -> list[int]:
    codes = [*map(ord, text)]
    return [(sum(c * 31 ** (g - 1 - k) for k, c in enumerate(codes[i : i + g])) + 1013 * side + 131 * g) % BUCKETS for g in GRAMS for i in range(len(codes) - g + 1)]


def fit(rows: list[tuple[str, str, int]] | None = None, steps: int = 25, ridge: float = 0.1, caution: float = 2.0) -> tuple[list[float], float]:
    """(weights, bias) of the regression by Newton steps in the span of the labelled urls; label 0 weighs ``caution`` times label 1. The bias
    is not penalised."""
    rows = labelled() if rows is None else rows
    if not rows:
        return [0.0] * BUCKETS, -1.0
    x, y = np.zeros((len(rows), BUCKETS)), np.array([r[2] for r in rows], float)
    for k, (host, path, _) in enumerate(rows):
        own = _buckets(f"^{host}$", 0) + _buckets(f"^{path}$", 1)
        np.add.at(x[k], own, UNIT)
    weight = np.where(y == 1, 1 / max(1, y.sum()), caution / max(1, (1 - y).sum())) * len(y) / (1 + caution)
    gram, a, b = x @ x.T, np.zeros(len(rows)), 0.0
    for _ in range(steps):
        margin = gram @ a + b
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        curve = np.maximum(weight * p * (1 - p), 1e-6)
        # Kernel form of a Newton step: (gram + ridge / curve) a + b = margin + (y - p) * weight / curve, with a summing to 0.
        left = np.block([[gram + np.diag(ridge / curve), np.ones((len(rows), 1))], [np.ones((1, len(rows))), np.zeros((1, 1))]])
        found = np.linalg.solve(left, np.append(margin + weight * (y - p) / curve, 0.0))
        done = np.abs(found[:-1] - a).max() < 1e-7
        a, b = found[:-1], float(found[-1])
        if done:
            break
    return [round(UNIT * float(v), 6) for v in x.T @ a], round(b, 6)


_fitted: list[tuple[list[float], float]] = []


def model() -> tuple[list[float], float]:
    if not _fitted:
        _fitted.append(fit())
    return _fitted[0]


def margin(fitted: tuple[list[float], float], host: str, path: str) -> float:
    """The regression's value of one url, as the SQL has it; block from 0 on."""
    weights, bias = fitted
    return bias + sum(weights[b] for side, text in enumerate((f"^{host}$", f"^{path}$")) for b in _buckets(text, side))


def _grams(text: str, side: int, size: int, array: str) -> str:
    code = " + ".join(f"ascii(substring({text}, i + {k}, 1)) * {31 ** (size - 1 - k)}L" for k in range(size))
    return f"case when length({text}) >= {size} then aggregate(transform(sequence(1, length({text}) - {size - 1}), i -> {array}[cast(pmod({code} + {1013 * side + 131 * size}, {BUCKETS}) as int)]), 0D, (a, v) -> a + v) else 0D end"


def filter_urls(pages: DataFrame, rules=RULES, fitted: tuple[list[float], float] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row: page_id, host, path, rule (null if none fits), score (the regression's, 0 to 1) and verdict."""
    weights, bias = fitted or model()
    rest = F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")).withColumn("rest", rest)
    rows = rows.withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0)).withColumn("path", F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), "^[^?#]*", 0))
    rows = rows.withColumn("host", F.translate("raw", _ALPHABET, _ALPHABET.lower()))
    fits = [
        F.when((F.concat(F.lit("."), F.col("host")).endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    best = F.array_max(F.filter(F.array(*fits), lambda r: r.isNotNull())) if fits else F.lit(None).cast("struct<n: int, rule: string, verdict: string>")
    weighed = f"cast(split('{','.join(map(str, weights))}', ',') as array<double>)"  # folded to one constant
    h, p = "concat('^', host, '$')", "concat('^', path, '$')"
    value = " + ".join([f"{bias}D", *[_grams(t, side, g, weighed) for side, t in enumerate((h, p)) for g in GRAMS]])
    rows = rows.withColumn("best", best).withColumn("score", F.expr(f"1 / (1 + exp(-({value})))"))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "score")


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("score")


def sql() -> str:
    """DuckDB SQL for op7, with the fitted weights as a list."""
    weights, bias = model()
    w = "[" + ", ".join(map(str, weights)) + "]"
    code = lambda t, g: " + ".join(f"unicode({t}[i + {k}])::BIGINT * {31 ** (g - 1 - k)}" for k in range(g))
    part = lambda t, side, g: f"coalesce(list_sum(list_transform(range(1, greatest(length({t}) - {g - 2}, 1)), lambda i: w[(({code(t, g)} + {1013 * side + 131 * g}) % {BUCKETS})::INT + 1])), 0)"
    value = " + ".join(part(t, side, g) for side, t in enumerate("hp") for g in GRAMS)
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH m AS (SELECT {w}::DOUBLE[] AS w),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, '{_ALPHABET}', '{_ALPHABET.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
r(v, h, p) AS (VALUES {rules}),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM c, r WHERE ends_with('.' || host, '.' || h) AND starts_with(path, p) GROUP BY page_id),
s AS (SELECT c.*, '^' || host || '$' AS h, '^' || path || '$' AS p FROM c)
SELECT s.page_id, host, path, f.rule, coalesce(f.v, CASE WHEN {bias} + {value} >= 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM s JOIN m ON true LEFT JOIN f USING (page_id)"""
