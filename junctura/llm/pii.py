"""Personal data by candidate gradient boosting, in SQL functions only.

Fixed patterns give the base spans (email, ip, card, phone); these always stay. High-recall generators propose further spans,
which may overlap each other: loosely written numbers, assignments of secrets, long mixed tokens and spelled-out addresses.
Boosted trees judge each by its format (lengths, digit groups, shapes) and its context (words just before it), and a threshold for
each generator, calibrated on examples kept apart, selects what is added, but for what lies within a base span or an accepted one of an
earlier kind. The trees are fitted here on a small table of examples that is built from templates, and are applied as SQL expressions
inside the scan: no row is moved.

Spans are code points, end exclusive. The position of a match is the sum of the lengths of all text and matches before it;
matches are taken in blocks, spans are compared by running maxima over blocks, and redacted text is put together from pieces, so the
time is about linear in texts with very many of them.

Defined cases: a null text counts as empty and has no span; other columns are ignored; repeated rows each get a row; an empty
table gives an empty result. Patterns use possessive repeats, so no text of any length makes them back up or recurse.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_LOCAL = "A-Za-z0-9._%+-"
#: In the order of listing; each is (pattern, what a text must hold for the pattern to be tried).
BASE = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "{t} rlike r'[0-9]\\.[0-9]'"),
    "card": (r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+", "{t} rlike r'[0-9][\\x20-]?[0-9]'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')"),
}
GENERATORS = {
    "number": (r"(?<![A-Za-z0-9.+])[(]?[0-9](?:[0-9]|[ ().-]{1,2}(?=[0-9(])){6,24}+(?![A-Za-z0-9])", "{t} rlike r'[0-9]'"),
    "secret": (r"(?i)(?<![a-z])(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|auth)\x22? ?[:=] ?\x22?[a-z0-9+/_.~-]{8,}+", "{t} rlike r'[:=]'"),
    "key": (r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+", "{t} rlike r'[0-9]'"),
    "contact": (r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{2,40}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{2,40}+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{2,20}+)++", "{t} rlike r'[\\[(](?:at|AT)[\\])]'"),
}
KINDS = [*BASE, *GENERATORS]
#: Spans of a block, and characters of a piece of text.
_BLOCK, _PIECE = 256, 4096
_LUHN = (
    "aggregate(transform(split(reverse({d}), ''), (c, i) -> if(i % 2 = 0, cast(c as int), if(cast(c as int) > 4, 2 * cast(c as int) - 9, 2 * cast(c as int)))), 0, (a, x) -> a + x) % 10 = 0"
)
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
KEEP = {
    "email": "true",
    "ip": r"forall(split(x.m, r'\.'), p -> coalesce(try_cast(p as decimal(38, 0)) <= 255, false))",
    "card": f"case when length({_DIGITS}) between 14 and 19 then {_LUHN.format(d=_DIGITS)} else false end",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
_PHONE_WORDS = r"(?:phone|tel|call|fax|mobile|cell|whatsapp|contact|dial)[^a-z]*$"
_ID_WORDS = r"(?:ssn|social security|passport|account|acct|iban|licen[cs]e|tax id|card|id)[^a-z]*$"
_SECRET_WORDS = r"(?:password|passwd|token|secret|key|auth|bearer)[^a-z]*$"
#: What the trees see of a candidate x: its text m and the lower-cased text c before it.
FEATURES = {
    "length": "length(x.m)",
    "digits": "length(regexp_replace(x.m, '[^0-9]', ''))",
    "letters": "length(regexp_replace(x.m, '[^A-Za-z]', ''))",
    "groups": "regexp_count(x.m, '[0-9]+')",
    "longest": "array_max(transform(split(x.m, '[^0-9]+'), g -> length(g)))",
    "turns": "regexp_count(x.m, '[0-9][A-Za-z]|[A-Za-z][0-9]')",
    "distinct": "size(array_distinct(split(lower(x.m), '')))",
    "phone_shape": r"cast(x.m rlike r'^[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$' as int)",
    "id_shape": r"cast(x.m rlike r'^[0-9]{3}-[0-9]{2}-[0-9]{4}$' as int)",
    "date_shape": r"cast(x.m rlike r'^(?:[0-9]{4}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-][0-9]{4})' as int)",
    "hyphens": "length(regexp_replace(x.m, '[^_-]', ''))",
    "phone_word": f"cast(x.c rlike r'{_PHONE_WORDS}' as int)",
    "id_word": f"cast(x.c rlike r'{_ID_WORDS}' as int)",
    "secret_word": f"cast(x.c rlike r'{_SECRET_WORDS}' as int)",
}


def _draw(n: int):
    """A fixed sequence of numbers below a bound."""
    state = n
    while True:
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        yield state >> 33


def examples() -> list[tuple[str, str, str, int]]:
    """(generator, context, candidate, label), from templates: ``#`` a digit, ``?`` a letter, ``%`` one of both."""
    wanted = {
        "number": ["###-###-####", "(###) ###-####", "### ### ####", "###.###.####", "###-##-####", "## ## ## ## ##", "##########"],
        "secret": ["password=%%%%%%%%%%%%%%%%%%", "token = \"%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%", "api_key: %%%%%%%%%%%%%%%%", "secret=%%%%%%%%%%%%", "pwd=%%%%%%%%%%"],
        "key": ["%%%%%%%%%%%%%%%%%%%%%%%%", "%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%", "%%%%%%%%-%%%%-%%%%-%%%%-%%%%%%%%%%%%"],
        "contact": ["????.????(at)?????(dot)com", "????? [at] ?????? [dot] org", "??? (at) ????.net", "????(at)????(dot)com"],
    }
    other = {
        "number": ["####-##-##", "##-##-####", "# # # # # # # #", "## ## ##", "########", "#.######", "### ### ###", "####-####", "#### #### ##", "### ## # ### ##"],
        "secret": ["token = identifier", "password: required", "secret=undisclosed", "auth: optional.only", "token: something-else"],
        "key": ["??????-?????-????????-##", "chapter-##-section-##-page", "????????????????????_#", "##################-####", "####################"],
        "contact": ["?? (at) ##.##", "# (at) ## . ##"],
    }
    before = {"number": ["call me at ", "phone: ", "tel. ", "mobile ", "ssn ", "account ", "the of and ", "onthe "], "secret": ["the and ", ""], "key": ["token ", "bearer ", "secret ", "and the "], "contact": ["mail ", "the "]}
    plain = ["in the year ", "pages ", "on ", "price ", "isbn ", "chapter ", "of the "]
    draw, rows = _draw(7), []

    def fill(shape: str) -> str:
        return "".join("0123456789"[next(draw) % 10] if c == "#" else "abcdefghijklmnopqrstuvwxyz"[next(draw) % 26] if c == "?" else "0123456789abcdef"[next(draw) % 16] if c == "%" else c for c in shape)

    for label, side in ((1, wanted), (0, other)):
        for g, shapes in side.items():
            for n in range(max(10, 70 // len(shapes))):
                for shape in shapes:
                    words = before[g] if label else plain
                    rows.append((g, words[n % len(words)], fill(shape), label))
    return rows


def boost(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.4, leaf: float = 2.0) -> tuple[float, list]:
    """Newton boosting of the logistic loss; a tree is a leaf's value or (feature, threshold, below, above)."""
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, out = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gain, best = 1e-6, None
        total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1]) if left else ():
            values = np.unique(x[rows, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[rows, f] < cut
                hl, hr = h[rows][low].sum(), h[rows][~low].sum()
                if min(low.sum(), (~low).sum()) < leaf:
                    continue
                new = g[rows][low].sum() ** 2 / (hl + 1) + g[rows][~low].sum() ** 2 / (hr + 1) - total
                if new > gain:
                    gain, best = new, (f, float(cut), low)
        if best is None:
            return round(float(-rate * g[rows].sum() / (h[rows].sum() + 1)), 6)
        f, cut, low = best
        return f, cut, grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        out.append(tree)
        margin = margin + np.array([value(tree, r) for r in x])
    return base, out


def margins(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree

    return np.array([model[0] + sum(value(t, r) for t in model[1]) for r in x])


_models: dict[str, dict] = {}


def train(spark: SparkSession, precision: float = 0.95) -> dict:
    """The trees and a threshold for each generator, fitted on ``examples()``; kept for the application."""
    key = spark.sparkContext.applicationId
    if key in _models:
        return _models[key]
    rows = examples()
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quote(g)}, {quote(c)}, {quote(m)}, {n})" for n, (g, c, m, _) in enumerate(rows))
    named = ", ".join(f"{e} as {n}" for n, e in FEATURES.items())
    found = spark.sql(f"select n, g, {named} from (select n, g, struct(lower(c) as c, m) as x from values {values} t(g, c, m, n))").collect()  # as many rows as examples()
    found.sort(key=lambda r: r["n"])
    x = np.array([[float(list(GENERATORS).index(r["g"])), *(float(r[f]) for f in FEATURES)] for r in found])
    y = np.array([label for *_, label in rows], float)
    apart = np.arange(len(y)) % 3 == 0
    model = boost(x[~apart], y[~apart])
    margin = margins(model, x[apart])
    limits = {}
    for k, g in enumerate(GENERATORS):
        own = x[apart][:, 0] == k
        cuts = sorted(margin[own])
        good = [c for c in cuts if y[apart][own][margin[own] >= c].mean() >= precision]
        limits[g] = round(float(max(0.0, min(good, default=1e9))), 6)
    _models[key] = {"base": model[0], "trees": model[1], "limits": limits}
    return _models[key]


def _tree_sql(tree, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree}D"
    f, cut, low, high = tree
    return f"if({names[f]} < {cut}D, {_tree_sql(low, names)}, {_tree_sql(high, names)})"


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, text, base and added, arrays of (s, k, e): start, index in KINDS, end."""
    model = train(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _with_spans(rows, "text", model).select("doc_id", "text", "base", "added")


def _with_spans(rows: DataFrame, text: str, model: dict) -> DataFrame:
    """``rows`` with base and added. Each stage reads what the one before made, so nothing is worked out twice: the optimiser merges a
    column into the next one where that names it once, also inside a lambda, so what a lambda reads is named twice (its size is asked for)."""
    wanted = BASE | GENERATORS
    spell = "array<struct<s: int, e: int, m: string, c: string>>"
    rows = rows.withColumns({f"m_{k}": F.expr(f"case when {gate.format(t=text)} then regexp_extract_all({text}, r'{p}', 0) end") for k, (p, gate) in wanted.items()})
    rows = rows.withColumns({f"p_{k}": F.expr(f"case when size(m_{k}) > 0 then split({text}, r'{p}', -1) end") for k, (p, _) in wanted.items()})
    rows = rows.withColumns({f"a_{k}": F.expr(f"zip_with(slice(p_{k}, 1, size(m_{k})), m_{k}, (p, m) -> struct(length(p) as g, length(m) as l, m as m, lower(right(p, 24)) as c))") for k in wanted})
    blocks = lambda k: f"sequence(0, (size(a_{k}) - 1) div {_BLOCK})"
    part = lambda k: f"slice(a_{k}, i * {_BLOCK} + 1, {_BLOCK})"
    rows = rows.withColumns({f"b_{k}": F.expr(f"case when a_{k} is not null then transform({blocks(k)}, i -> aggregate({part(k)}, 0, (n, x) -> n + x.g + x.l)) end") for k in wanted})
    place = "(z, x) -> struct(z.at + x.g + x.l as at, concat(z.out, array(struct(z.at + x.g as s, z.at + x.g + x.l as e, x.m as m, x.c as c))) as out)"
    rows = rows.withColumns(
        {
            f"s_{k}": F.expr(
                f"case when size(b_{k}) > 0 then flatten(transform({blocks(k)}, i -> aggregate({part(k)}, struct(aggregate(slice(b_{k}, 1, i), 0, (n, x) -> n + x) as at, cast(array() as {spell}) as out), {place}, z -> z.out))) end"
            )
            for k in wanted
        }
    )
    shape = "array<struct<s: int, k: int, e: int>>"
    cut = lambda k, test: f"coalesce(transform(filter(s_{k}, x -> {test}), x -> struct(x.s as s, {KINDS.index(k)} as k, x.e as e)), cast(array() as {shape}))"
    rows = rows.withColumn("base", F.expr(f"array_sort(concat({', '.join(cut(k, KEEP[k]) for k in BASE)}))"))
    names = ["0", *(f"y.{n}" for n in FEATURES)]
    seen = ", ".join(f"cast({e} as double) as {n}" for n, e in FEATURES.items())
    judged = []
    for n, k in enumerate(GENERATORS):
        names[0] = f"{n}D"
        total = " + ".join([f"{model['base']}D", *(_tree_sql(t, names) for t in model["trees"])])
        rows = rows.withColumn(f"f_{k}", F.expr(f"transform(s_{k}, x -> struct(x.s as s, x.e as e, {seen}))"))
        judged.append(f"coalesce(transform(filter(f_{k}, y -> {total} >= {model['limits'][k]}D), y -> struct(y.s as s, {KINDS.index(k)} as k, y.e as e)), cast(array() as {shape}))")
    rows = rows.withColumn("judged", F.expr(f"array_sort(concat({', '.join(judged)}))"))
    rows = rows.withColumn("every", F.expr("case when size(judged) > 0 then array_sort(concat(base, judged)) end"))
    # A span lies within one of an earlier kind if the largest end among those before it in this order reaches its own end.
    first, own = len(BASE), f"slice(every, i * {_BLOCK} + 1, {_BLOCK})"
    numbers = f"sequence(0, (size(every) - 1) div {_BLOCK})"
    most = lambda array: f"coalesce(array_max({array}), 0)"
    limits = f"array({', '.join(str(k) for k in range(first, len(KINDS)))})"
    rows = rows.withColumn("tops", F.expr(f"transform({numbers}, i -> transform({limits}, g -> {most(f'transform(filter({own}, y -> y.k < g), y -> y.e)')}))"))
    rows = rows.withColumn("carried", F.expr(f"case when size(tops) > 0 then transform({numbers}, i -> transform({limits}, g -> {most(f'transform(slice(tops, 1, i), z -> z[g - {first}])')})) end"))
    reached = f"greatest(carried[i][x.k - {first}], {most(f'transform(filter(slice(every, i * {_BLOCK} + 1, j), y -> y.k < x.k), y -> y.e)')})"
    free = f"filter(transform({own}, (x, j) -> if(x.k < {first} or {reached} >= x.e, null, x)), x -> x is not null)"
    return rows.withColumn("added", F.expr(f"case when size(judged) > 0 and size(carried) > 0 then flatten(transform({numbers}, i -> {free})) else cast(array() as {shape}) end"))


_NAMES = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"


def written(array: str) -> str:
    """SQL for kind:start:end, comma-joined."""
    return f"array_join(transform({array}, x -> concat({_NAMES}[x.k], ':', x.s, ':', x.e)), ',')"


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; overlapping spans become one."""
    names = docs.columns
    wide = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"
    rows = _with_spans(wide.withColumn("t", F.coalesce(F.col(text), F.lit(""))), "t", train(docs.sparkSession))
    rows = rows.withColumn("cut", F.expr("case when size(base) + size(added) > 0 then array_sort(concat(base, added)) end"))
    numbers, own = f"sequence(0, (size(cut) - 1) div {_BLOCK})", f"slice(cut, i * {_BLOCK} + 1, {_BLOCK})"
    most = lambda array: f"coalesce(array_max({array}), 0)"
    rows = rows.withColumn("tops", F.expr(f"transform({numbers}, i -> {most(f'transform({own}, y -> y.e)')})"))
    rows = rows.withColumn("carried", F.expr(f"case when size(tops) > 0 then transform({numbers}, i -> {most('slice(tops, 1, i)')}) end"))
    reached = f"greatest(carried[i], {most(f'transform(slice(cut, i * {_BLOCK} + 1, j), y -> y.e)')})"
    # The spans that begin beyond all before them, with the end of those; and the text in pieces, so that a place is found in one of them.
    heads = f"case when size(carried) > 0 then filter(flatten(transform({numbers}, i -> transform({own}, (x, j) -> struct(x.s as s, x.k as k, {reached} as at)))), h -> h.s >= h.at) end"
    rows = rows.withColumn("heads", F.expr(heads)).withColumn("pieces", F.expr(f"case when cut is not null then regexp_extract_all(t, '(?s).{{1,{_PIECE}}}', 0) end"))
    some = lambda a, b: f"if({a} div {_PIECE} = {b} div {_PIECE}, substring(pieces[{a} div {_PIECE}], {a} % {_PIECE} + 1, {b} - {a}), concat({rest(a)}, array_join(slice(pieces, {a} div {_PIECE} + 2, {b} div {_PIECE} - {a} div {_PIECE} - 1), ''), coalesce(substring(get(pieces, {b} div {_PIECE}), 1, {b} % {_PIECE}), '')))"
    rest = lambda a: f"coalesce(substring(get(pieces, {a} div {_PIECE}), {a} % {_PIECE} + 1), '')"
    rows = rows.withColumn("last", F.expr("array_max(transform(cut, y -> y.e))"))
    shown = f"array_join(transform(heads, h -> concat(if(h.s > h.at, {some('h.at', 'h.s')}, ''), '[', upper({_NAMES}[h.k]), ']')), '')"
    new = F.expr(f"case when cut is not null then concat({shown}, {rest('last')}, array_join(slice(pieces, last div {_PIECE} + 2, size(pieces)), '')) else {text} end")
    return rows.withColumn("new", new).select(*[(F.col("new") if n == text_col else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = {KINDS.index(k)})) as long)").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(F.expr(written("base")), 256).alias("base_sha256"), F.expr(written("array_sort(concat(base, added))")).alias("spans"))
