"""Personal data: candidate spans scored by boosted trees.

Base spans are the leftmost matches, one kind after another, of four fixed patterns (email, ip, card, phone) that
pass their checks (parts up to 255, Luhn, numbers of digits). High-recall generators propose further spans, which may
overlap: written-out email addresses, telephone numbers without a plus, national ids, account numbers, keys and
passwords, and what a base pattern found but its check dropped. Gradient-boosted trees score them by format and
context features, and a threshold for each kind selects them. A candidate that overlaps a base span is left out, so
base spans always stay.

The trees are fitted on the driver in numpy. Examples are TRAIN made-up ones (the seed is fixed): templates of each
kind in neutral and telling contexts, against look-alikes such as prices, times, versions, licence and order numbers;
and, where a corpus is given, up to SAMPLE of its own matches with weak labels. Base spans there become examples as
they would look to a generator (addresses written out, telephone numbers without country), what failed a check is a
look-alike, and a long string is a secret if it is assigned to a name of one. Thresholds keep a precision of PRECISION
on formats that were not seen: each template, and each kind of the corpus, is scored by trees fitted without it, and
the threshold of a kind is read from those scores. Features are the same Spark expressions in fitting and use. The
trees run as nested IF expressions; only built-in expressions run on the executors, row by row, with no shuffle.

The patterns are written so that they take time in proportion to the text (possessive, and starting only where
a leftmost match can start), with the same matches as the plain ones. Places of matches and their overlaps come from
running sums and maxima over blocks of BLOCK matches, so a text's time doesn't grow with the square of its matches.

Cases: a null text is empty and has no spans. Positions are code points, the end exclusive. Repeated rows are
returned as often as they occur. A text of any length is searched whole. An empty table gives an empty result, and
teaches nothing. Other columns are carried as they are."""

from __future__ import annotations

import json
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import table

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Generators of further candidates, by the kind they propose.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]++(?:(?: ?[(\[{] ?dot ?[)\]}] ?|\.)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+=*",
    "password": r"(?<=(?i:password|passwd|secret|pwd|token|api_key) ?[=:] ?[\"']?)[^\s\"',;]{6,}+",
}
#: What a generator's spans are called, where it isn't by its name.
CALLED = {"password": "secret"}
#: Cheap signs, linear in the text, that a generator can match.
GENERATOR_SIGNS = {"email": "t RLIKE '[(\\[{] ?at ?[)\\]}]'", "secret": "t RLIKE '[A-Za-z0-9+/_-]{16}'", "password": "t RLIKE '(?i:password|passwd|secret|pwd|token|api_key) ?[=:]'"}
ALL = (*KINDS, "ssn", "iban", "secret")
TRAIN, SAMPLE, TREES, DEPTH, RATE, PRECISION, SEED, CONTEXT, BLOCK, FOLDS = 4000, 2000, 32, 4, 0.3, 0.95, 5, 24, 128, 6


SPANS = "array<struct<kind: string, s: int, e: int, m: string, l: string>>"


def _running(rows: DataFrame, array: str, value: str, zero: str, op: str, out: str) -> DataFrame:
    """Adds `out`: for each element y of an array what `op` makes of the values before it. Blocks are reduced first, so
    no array is copied as often as it has elements."""
    kind = "CAST(array() AS array<int>)"
    step = lambda v, y: op.replace("{a}", v).replace("{b}", value.replace("y.", f"{y}."))
    rows = rows.withColumn("_bs", F.expr(f"transform(sequence(0, greatest(size({array}) - 1, 0) DIV {BLOCK}), i -> slice({array}, i * {BLOCK} + 1, {BLOCK}))"))
    first = f"aggregate(_bs, named_struct('a', {zero}, 'o', {kind}), (st, bl) -> named_struct('a', aggregate(bl, st.a, (v, y) -> {step('v', 'y')}), 'o', array_append(st.o, st.a)), st -> st.o)"
    rows = rows.withColumn("_ps", F.expr(first))
    inside = f"aggregate(bl, named_struct('a', p0, 'o', {kind}), (st, y) -> named_struct('a', {step('st.a', 'y')}, 'o', array_append(st.o, st.a)), st -> st.o)"
    return rows.withColumn(out, F.expr(f"flatten(zip_with(_bs, _ps, (bl, p0) -> {inside}))")).drop("_bs", "_ps")


def _found(rows: DataFrame, name: str, kind: str, pattern: str, sign: str) -> DataFrame:
    """Adds `name`: all matches of a pattern in t with their places and the CONTEXT characters before them (through the
    match before, if that is near)."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    rows = rows.withColumn("_g", F.expr(f"CASE WHEN {sign} THEN split(t, '{p}', -1) ELSE array('') END")).withColumn("_m", F.expr(f"CASE WHEN size(_g) > 1 THEN regexp_extract_all(t, '{p}', 0) ELSE CAST(array() AS array<string>) END"))
    both = "zip_with(slice(_g, 1, size(_m)), _m, (g, m) -> named_struct('g', g, 'm', m))"
    rows = rows.withColumn("_x", F.expr(f"zip_with({both}, slice(concat(array(''), _m), 1, size(_m)), (x, q) -> named_struct('g', length(x.g), 'n', length(x.m), 'm', x.m, 'l', right(concat(q, x.g), {CONTEXT})))"))
    rows = _running(rows, "_x", "y.g + y.n", "0", "{a} + {b}", "_at")
    made = f"zip_with(_x, _at, (x, p) -> named_struct('kind', '{kind}', 's', p + x.g, 'e', p + x.g + x.n, 'm', x.m, 'l', x.l))"
    return rows.withColumn(name, F.expr(f"CAST({made} AS {SPANS})")).drop("_g", "_m", "_x", "_at")


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    d = _digits(m)
    twice = f"transform(split(reverse({d}), ''), (c, i) -> CAST(c AS int) * (1 + i % 2))"
    return f"aggregate(filter({twice}, v -> v IS NOT NULL), 0, (a, v) -> a + IF(v > 9, v - 9, v)) % 10 = 0"


#: Checks of base matches (m): what fails is dropped.
CHECKS = {
    "email": "true",
    "ip": f"x.m RLIKE '^{PART}\\\\.{PART}\\\\.{PART}\\\\.{PART}$'",
    "card": f"length({_digits('x.m')}) BETWEEN 16 AND 19 AND {_luhn('x.m')}",
    "phone": f"length({_digits('x.m')}) BETWEEN 8 AND 15",
}
#: A cheap sign that a pattern can match at all.
SIGNS = {"email": "contains(t, '@')", "ip": "digit", "card": "digit", "phone": "contains(t, '+')"}

#: Features of a candidate c in its text t, by name.
FEATURES = {
    "kind": "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(ALL)) + " END",
    "length": "length(c.m)",
    "digits": "length(regexp_replace(c.m, '[^0-9]', ''))",
    "upper": "length(regexp_replace(c.m, '[^A-Z]', ''))",
    "lower": "length(regexp_replace(c.m, '[^a-z]', ''))",
    "marks": "length(regexp_replace(c.m, '[A-Za-z0-9]', ''))",
    "groups": "size(split(c.m, '[^A-Za-z0-9]+'))",
    "variety": "size(array_distinct(split(c.m, '')))",
    "turns": "length(regexp_replace(regexp_replace(regexp_replace(c.m, '[0-9]+', '0'), '[A-Z]+', 'A'), '[a-z]+', 'a'))",
    "hex": "CAST(c.m RLIKE '^[0-9a-f]+$' AS int)",
    "key_name": "CAST(lower(c.l) RLIKE '(password|passwd|secret|token|key|pwd)[^a-z0-9]*$' AS int)",
    "assigned": "CAST(c.l RLIKE '[=:][ \"]*$' AS int)",
    "told": "CAST(lower(c.l) RLIKE '(phone|tel|call|fax|mobile|cell|ssn|social|iban|account|mail|card|contact|reach)[^0-9]*$' AS int)",
    "numbered": "CAST(lower(c.l) RLIKE '(no|nr|order|version|isbn|invoice|item|ref|page|build|commit|sha|sha256|md5|digest|revision|id)[.:#]? *$' AS int)",
    "prefix": "CAST(c.m RLIKE '^(AKIA|ASIA|ghp_|sk_|xox)' AS int)",
    "money": "CAST(c.l RLIKE '[$€£]$' AS int)",
}


#: Formats of made-up examples by kind and label, each with what may stand before it. 9 is a digit, A and a are letters,
#: h hexadecimal, x letters of both cases and digits, w a word, W a capitalized one; a number after a sign repeats it
#: (h{40}), and what is in brackets <> stands as it is.
NUMBERED = ["<order no. >", "<ref >", "<item >", "<invoice >", "<page >", "<build >", "<id: >", "<part no. >", "<isbn >", "<serial no. >"]
ASSIGNED = ["<password=>", "<token = \">", "<secret: >", "<api_key=>", "<pwd=\">", "<secret_key = >", "<token: >", "<passwd=>"]
FORMATS = [
    *[("email", 1, f, ["", "<mail: >", "<contact >", "<write to >"]) for f in ("w< (at) >w< (dot) com>", "w<.>w< [at] >w< [dot] org>", "w<(at)>w<.>w<.net>", "w99< [at] >w<.com>", "w<_>w< {at} >w< {dot} com>", "w< (at) >w<->w< (dot) co (dot) uk>")],
    *[("email", 0, f, ["", "<sold >", "<priced >"]) for f in ("99< (at) >99.99", "9< [at] >9.9", "999< (at) >9.9.9")],
    *[("phone", 1, f, ["", "<call >", "<phone: >", "<tel. >", "<mobile >", "<fax >", "<reach me at >"]) for f in ("(999) 999-9999", "999-999-9999", "999.999.9999", "999 999 9999", "(999) 999 9999", "(999)-999-9999", "099 9999 9999", "0999 999 9999")],
    *[("phone", 0, f, NUMBERED) for f in ("9999 9999 9999", "9999-999-999", "999-9999-9999", "9999.999.9999", "999 9999 9999", "99-999-999", "9999-9999-9999")],
    *[("phone", 0, f, ["<$>", "<€>", "<£>", "<total >", "<about >", ""]) for f in ("99.999.999", "99 999 999", "999.999.999", "999 999 999")],
    ("phone", 0, "99.999.999", ["<version >", "<build >"]), ("phone", 0, "<+>999", ["", "<a >"]), ("phone", 0, "<+>9{18}", ["", "<no. >"]),
    ("ssn", 1, "999-99-9999", [""]), ("ssn", 1, "999-99-9999", ["<ssn >", "<ssn: >"]), ("ssn", 1, "999-99-9999", ["<social security >", "<social security number: >"]), ("ssn", 1, "999-99-9999", ["<his >", "<for >"]),
    *[("ssn", 0, "999-99-9999", [c]) for c in NUMBERED],
    *[("iban", 1, f, ["", "<iban >", "<IBAN: >", "<account: >", "<pay to >"]) for f in ("AA99 9999 9999 9999 9999 99", "AA99 AAAA 9999 9999 9999 99", "AA9{18}", "AA99AAAA9{14}", "AA99 9999 9999 9999 9999 9999 999")],
    *[("iban", 0, f, ["", "<THE >", "<code >"]) for f in ("AA99 AAAA AAAA AAAA", "AA99A{12}", "AA99 AAAA AAAA AAAA AAAA", "AA99A{16}A")],
    *[("secret", 1, f, ["", "<key >", "<id >", "<AWS_KEY=>", "<use >"]) for f in ("<AKIA>A{16}", "<ASIA>A{16}", "<ghp_>x{36}", "<sk_>x{24}", "<xoxb->x{24}")],
    *[("secret", 1, f, ASSIGNED) for f in ("h{24}", "h{32}", "h{40}", "h{64}", "x{20}", "x{32}", "x{40}", "x{42}<==>", "x{8}<!>", "w99<!>x", "WWWW", "WWW99", "x{12}<#$>", "w<->w<->w99")],
    *[("secret", 0, f, ["", "<the >", "<and >", "<see >", "<at >", "<class >"]) for f in ("a{18}", "a{26}", "w<->w<->w<->w<->w", "w<_>w<_>w<_>w", "w</>w</>w</>w99", "A{18}", "WWWW", "w</>w</>w</>w", "9{18}", "9{22}", "AAAA<->A{8}<->A{6}")],
    *[("secret", 0, f, ["<commit >", "<sha >", "<sha256 >", "<md5 >", "<build >", "<digest >", "", "<revision >"]) for f in ("h{40}", "h{32}", "h{64}")],
    *[("secret", 0, f, ["<password: >", "<secret: >", "<token: >", "<password = >"]) for f in ("<required>", "w", "aaaaaa", "<changed>", "<reset,>", "a{9}")],
    ("ip", 0, "999.9999.99.9", ["<version >", "<build >", ""]), ("ip", 0, "99.9.99999.9999", ["<version >", ""]),
    *[("card", 0, f, ["<order >", "<no. >", "", "<page >", "<call (>", "<phone: >", "<card >", "<+1 (>"]) for f in ("99", "999", "9999", "99999", "9{8}", "9{13}", "9{16}", "999-9999", "1999-99-99", "2099-99-99")],
]
LETTERS = {"9": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef", "x": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
TOKEN = re.compile(r"<([^>]*)>|([9aAhxwW])(?:\{(\d+)\})?|(.)", re.S)


def examples(n: int = TRAIN, seed: int = SEED) -> list[tuple[str, str, str, int, str]]:
    """Made-up (text before, match, kind, label, format), as many of each format."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(LETTERS["a"]) for _ in range(rng.randrange(3, 9)))

    def sign(m: re.Match) -> str:
        literal, kind, times, other = m.groups()
        if literal is not None or other:
            return literal or other or ""
        if kind in "wW":
            return word() if kind == "w" else word().capitalize()
        return "".join(rng.choice(LETTERS[kind]) for _ in range(int(times or 1)))

    fill = lambda f: TOKEN.sub(sign, f)
    out = []
    for i in range(n):
        k = i % len(FORMATS)
        kind, label, form, before = FORMATS[k]
        out.append((f"{word()} {word()} {fill(rng.choice(before))}", fill(form), kind, label, f"made {k}"))
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> tuple[float, list]:
    """Logistic boosting. A tree is a leaf's number or (feature, threshold, tree if <=, tree if >)."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f, grown = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        leaf = rate * float(g[rows].sum() / (h[rows].sum() + 1.0))
        best = (1e-6, None, None)
        for j in range(x.shape[1] if left else 0):
            order = rows[np.argsort(x[rows, j], kind="stable")]
            v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                gain = cg[cut] ** 2 / (ch[cut] + 1) + (cg[-1] - cg[cut]) ** 2 / (ch[-1] - ch[cut] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        _, j, t = best
        if j is None:
            f[rows] += leaf
            return leaf
        low = x[rows, j] <= t
        return (j, t, grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        grown.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth))
    return base, grown


def score(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    def of(tree, rows):
        if isinstance(tree, float):
            return np.full(len(rows), tree)
        j, t, a, b = tree
        low, out = x[rows, j] <= t, np.empty(len(rows))
        out[low], out[~low] = of(a, rows[low]), of(b, rows[~low])
        return out

    return model[0] + sum(of(t, np.arange(len(x))) for t in model[1])


def _case(tree) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    j, t, a, b = tree
    return f"IF(f[{j}] <= {t!r}D, {_case(a)}, {_case(b)})"


def _features(c: str) -> str:
    return "array(" + ", ".join(f"CAST({e.replace('c.', c + '.')} AS double)" for e in FEATURES.values()) + ")"


def weak_examples(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> list[tuple[str, str, str, int, str]]:
    """Up to `sample` matches of docs (those with the smallest hashes of match and context) as examples: (text before,
    match, kind, label, format)."""
    rows = _matched(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")))
    marked = ", ".join(f"transform(all_{k}, x -> named_struct('m', x.m, 'l', x.l, 'kind', '{k}', 'ok', {CHECKS[k]}))" for k in KINDS)
    secret = "transform(gen_secret, x -> named_struct('m', x.m, 'l', x.l, 'kind', 'secret', 'ok', lower(x.l) RLIKE '(password|passwd|secret|token|key|pwd) ?[=:] ?[\"\\']?$'))"
    each = rows.select(F.explode(F.expr(f"concat({marked}, {secret})")).alias("x")).select("x.*").filter("length(m) <= 200").distinct()
    out = []
    for r in each.orderBy(F.xxhash64("m", "l"), "m", "l", "kind").limit(sample).collect():
        if r.kind == "email":
            name, _, host = r.m.partition("@")
            out.append((r.l, f"{name} (at) {host.replace('.', ' (dot) ')}", "email", 1, "corpus email"))
        elif r.kind == "phone" and r.ok:
            out.append((r.l, r.m.lstrip("+0123456789").lstrip() or r.m[1:], "phone", 1, "corpus phone"))
        elif r.kind == "secret":
            out.append((r.l, r.m, "secret", int(r.ok), f"corpus secret {int(r.ok)}"))
        elif not r.ok:
            out.append((r.l, r.m, r.kind, 0, f"corpus {r.kind}"))
    return out


def _vectors(spark: SparkSession, made: list[tuple[str, str, str, int, str]]) -> np.ndarray:
    rows = [{"i": i, "l": left[-CONTEXT:], "m": m, "kind": kind} for i, (left, m, kind, _, _) in enumerate(made)]
    df = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<i: int, l: string, m: string, kind: string>>")).alias("d"))
    return np.array([r.f for r in df.select("d.i", F.expr(_features("d")).alias("f")).orderBy("i").collect()])


def fit(spark: SparkSession, docs: DataFrame | None = None, text_col: str = "text", sample: int = SAMPLE) -> tuple[tuple[float, list], dict[str, float]]:
    """Trees, and the threshold of each kind: the least score from which on PRECISION of the candidates, scored by
    trees that didn't see their format, are personal data, and never below even odds."""
    made = examples() + (weak_examples(docs, text_col, sample) if docs is not None else [])
    x, y = _vectors(spark, made), np.array([float(e[3]) for e in made])
    kinds, formats = np.array([e[2] for e in made]), np.array([e[4] for e in made])
    names = sorted(set(zip(kinds, y, formats)))  # so that the formats of a kind lie in different folds
    fold, blind = np.array([names.index(k) % FOLDS for k in zip(kinds, y, formats)]), np.empty(len(y))
    for i in range(FOLDS):
        blind[fold == i] = score(boost(x[fold != i], y[fold != i]), x[fold == i])
    limits = {}
    for kind in ALL:
        of = np.flatnonzero(kinds == kind)
        order = of[np.argsort(-blind[of], kind="stable")]
        precision = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        if not len(good):
            limits[kind] = float("inf") if len(of) else 0.0
            continue
        last = int(good.max())
        below = blind[order[min(last + 1, len(order) - 1)]]
        limits[kind] = max(0.0, float((blind[order[last]] + below) / 2))
    return boost(x, y), limits


def _matched(rows: DataFrame) -> DataFrame:
    """rows with text t: adds all_<kind> of base patterns and gen_<name> of generators."""
    rows = rows.withColumn("digit", F.expr("t RLIKE '[0-9]'"))
    for k in KINDS:
        rows = _found(rows, f"all_{k}", k, PATTERNS[k], SIGNS[k])
    for k, p in GENERATORS.items():
        rows = _found(rows, f"gen_{k}", CALLED.get(k, k), p, GENERATOR_SIGNS.get(k, "digit"))
    return rows


def spans(docs: DataFrame, text_col: str = "text", model: tuple | None = None) -> DataFrame:
    """docs as (row, t, base, more, ok_<kind>): base and added spans, arrays of (kind, s, e, m). model: what fit()
    gives; without one it is fitted on made-up examples alone."""
    (base, trees), limits = model or fit(docs.sparkSession)
    rows = _matched(docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t")))
    for k in KINDS:
        rows = rows.withColumn(f"ok_{k}", F.expr(f"filter(all_{k}, x -> {CHECKS[k]})"))
    failed = ", ".join(f"filter(all_{k}, x -> NOT ({CHECKS[k]}))" for k in KINDS if k != "email")
    rows = rows.withColumn("base", F.expr(f"concat({', '.join(f'ok_{k}' for k in KINDS)})"))
    rows = rows.withColumn("_c", F.expr(f"concat({', '.join(f'gen_{k}' for k in GENERATORS)}, {failed})"))
    # in order of their places: a candidate overlaps a base span if one before it ends after its start, or one after it
    # begins before its end
    tagged = ", ".join(f"transform({xs}, x -> named_struct('s', x.s, 'b', {b}, 'e', x.e, 'kind', x.kind, 'c', x))" for xs, b in (("base", 0), ("_c", 1)))
    rows = rows.withColumn("_all", F.expr(f"CASE WHEN size(_c) > 0 THEN array_sort(concat({tagged})) ELSE slice(concat({tagged}), 1, 0) END"))
    rows = _running(rows, "_all", "IF(y.b = 0, y.e, -1)", "-1", "greatest({a}, {b})", "_ends")
    rows = rows.withColumn("_back", F.expr("reverse(_all)"))
    rows = _running(rows, "_back", "IF(y.b = 0, y.s, 2147483647)", "2147483647", "least({a}, {b})", "_next")
    rows = rows.withColumn("_ok", F.expr("zip_with(zip_with(_all, _ends, (x, e) -> named_struct('x', x, 'e', e)), reverse(_next), (y, n) -> named_struct('c', y.x.c, 'ok', y.x.b = 1 AND y.e <= y.x.s AND n >= y.x.e))"))
    rows = rows.withColumn("_c", F.expr("transform(filter(_ok, x -> x.ok), x -> x.c)"))
    # two generators may propose the same span; they stand side by side
    rows = rows.withColumn("candidates", F.expr("filter(_c, (x, i) -> i = 0 OR NOT (get(_c, i - 1).s = x.s AND get(_c, i - 1).e = x.e AND get(_c, i - 1).kind = x.kind))"))
    # one tree after another, so that no expression nests deeply
    rows = rows.withColumn("scored", F.when(F.size("candidates") > 0, F.expr(f"transform(candidates, c -> named_struct('c', c, 'f', {_features('c')}))")))
    total = " + ".join([f"{base!r}D", *(_case(t).replace("f[", "x.f[") for t in trees)])
    limit = "CASE x.c.kind " + " ".join(f"WHEN '{k}' THEN {'double(\"infinity\")' if v == float('inf') else f'{v!r}D'}" for k, v in limits.items()) + " END"
    bare = lambda xs: f"transform({xs}, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'm', x.m))"
    chosen = F.expr(bare(f"transform(filter(scored, x -> {total} > {limit}), x -> x.c)"))
    rows = rows.withColumn("more", chosen).withColumn("base", F.expr(bare("base")))
    return rows.select("row", "t", "base", F.coalesce("more", F.expr("slice(base, 1, 0)")).alias("more"), *[f"ok_{k}" for k in KINDS])


def _joined(array: str) -> str:
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(ALL))
    rank = f"array_sort(transform({array}, x -> named_struct('k', CASE x.kind {order} END, 's', x.s, 'e', x.e, 'kind', x.kind)))"
    return f"array_join(array_distinct(transform({rank}, x -> concat_ws(':', x.kind, x.s, x.e))), ',')"


def redacted(docs: DataFrame, text_col: str = "text", model: tuple | None = None) -> DataFrame:
    """docs with every span, base or added, replaced by its kind in brackets. Spans that overlap are replaced
    together, under the kind of the first."""
    rows = spans(docs, text_col, model).withColumn("_s", F.expr("array_sort(transform(concat(base, more), x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"))
    rows = _running(rows, "_s", "y.e", "0", "greatest({a}, {b})", "_to")
    # a span stands for itself unless one before it reaches into it; what it covers ends where the next such one begins
    rows = rows.withColumn("_x", F.expr("zip_with(_s, _to, (x, p) -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind, 'to', p))")).withColumn("_h", F.expr("filter(_x, x -> x.s >= x.to)"))
    rows = rows.withColumn("_last", F.expr("aggregate(_s, 0, (a, x) -> greatest(a, x.e))")).withColumn("_ch", F.expr("CASE WHEN size(_h) > 0 THEN split(t, '') END"))
    text = "array_join(transform(_h, x -> concat(array_join(slice(_ch, x.to + 1, x.s - x.to), ''), '[', upper(x.kind), ']')), '')"
    done = F.expr(f"concat({text}, array_join(slice(_ch, _last + 1, greatest(0, size(_ch) - _last)), ''))")
    text = F.when(F.size("_h") > 0, done).otherwise(F.col(f"row.`{text_col}`"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def op7_pii_spans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = spans(docs, model=fit(spark, docs))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), *[F.size(f"ok_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("concat(base, more)")).alias("spans"),
        F.size("more").cast("long").alias("n_added"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )
