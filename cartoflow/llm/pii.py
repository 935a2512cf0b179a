"""Personal data by candidate gradient boosting, in DataFrame and SQL expressions only.

Four fixed patterns with their checks give the base spans.  Looser generators propose
candidates that may overlap them; a candidate's format and context become a few small
integers, and boosted depth-two trees score it.

What defines a base span (the '@', the check sum, the leading '+', the range of an octet) is
hidden from the trees, so that they learn how personal data looks and where it stands.  Three
kinds of candidates are told apart: those that meet a base span of their kind (positive), those
that something rules out (negative: a failing check sum, an octet over 255, a number in a
version or list, a date, a domain without letters), and open ones, which are neither.  Trees
learn positive against negative; a fifth of both (by a hash of the span) is kept back to set
each kind's threshold at the wanted precision; open candidates that reach it are added.  An
open candidate is never a label.  Without negatives nothing can be calibrated or added.

The trees never see the corpus: they are fitted on the counts of each feature combination over
all documents, whose number is bounded by the product of the features' ranges.  The fitted
trees become CASE expressions, so documents are scored in place without a shuffle.

Open candidates that meet a base span of any kind are not added; base spans always stay.

Defined results: null text counts as empty and has no span; a very long text is searched
whole, its matches in chunks; spans of one kind never overlap; an empty table gives an empty
result; rows with equal ids are searched separately; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns.  Possessive where nothing can be given back, and starting only where a
#: run starts, so that a long run costs linear time and no recursion.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to have a valid match.
NEEDED = {
    "email": "contains(t, '@')",
    "ip": r"t rlike '[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]'",
    "card": r"t rlike '[0-9](?:[\\x20-]?[0-9]){15}'",
    "phone": "contains(t, '+')",
}
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:[.,][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,3}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
}
LIKELY = {
    "email": r"t rlike '@|\\(at\\)|\\[at\\]'",
    "ip": r"t rlike '[0-9][.,][0-9]{1,3}[.,][0-9]{1,3}[.,][0-9]'",
    "card": r"t rlike '[0-9](?:[\\x20./-]{0,2}[0-9]){12}'",
    "phone": r"t rlike '[0-9]\\)?[\\x20./-]{1,2}\\(?[0-9]{2,4}\\)?[\\x20./-]{1,2}\\(?[0-9]{2}'",
}
#: Words near a span that speak for a kind (fixed lists).
CONTEXT = {"email": "mail|contact|write", "ip": "ip|host|server|addr", "card": "card|visa|account|pay", "phone": "phone|call|tel|fax|mobile"}
#: Characters of context on the left.
AROUND = 24
FEATURES = ("digits", "groups", "left", "right", "context", "tail")
#: Matches that are placed in one pass.
CHUNK = 256
#: Redaction wants recall: of the added spans one in ten may be wrong, as far as the kept-back labels tell.
ROUNDS, RATE, PRECISION = 24, 0.4, 0.9
#: Share of a kind's negatives that stand for an open candidate: of numbers that are no cards one in ten passes the check sum by chance.
CHANCE = {"card": 1 / 9}


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """Whether the digit string passes the check sum (doubling every second digit from the right)."""
    digit = f"cast(substring({d}, i, 1) as int)"
    worth = f"case when (length({d}) - i) % 2 = 0 then {digit} when {digit} > 4 then {digit} * 2 - 9 else {digit} * 2 end"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + {worth}) % 10 = 0"


def _valid(kind: str, m: str) -> str:
    d = _digits(m)
    if kind == "ip":
        return f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"
    if kind == "card":
        return f"length({d}) between 16 and 19 and {_luhn(d)}"
    if kind == "phone":
        return f"length({d}) between 8 and 15"
    return "true"


def _matches(pattern: str, needed: str) -> str:
    """All non-overlapping matches of ``t``: array of (m, p: characters since the last match, n: length)."""
    p = _sql(pattern)
    pairs = f"filter(zip_with(regexp_extract_all(t, {p}, 0), split(t, {p}), (m, p) -> named_struct('m', m, 'p', length(p), 'n', length(m))), x -> x.m is not null)"
    return f"case when {needed} then {pairs} else cast(array() as array<struct<m:string,p:int,n:int>>) end"


def _placed(found: str, valid: str) -> str:
    """The matches that pass, as an array of (s, e, m), code points, end exclusive.

    Positions are running sums, taken chunk by chunk, so that the cost of a text grows with its matches and not with their square.
    """
    nothing = "cast(array() as array<struct<s:int,e:int,m:string>>)"
    one = "concat(a.out, array(named_struct('s', a.at + x.p, 'e', a.at + x.p + x.n, 'm', x.m)))"
    merge = f"(a, x) -> named_struct('at', a.at + x.p + x.n, 'out', case when {valid} then {one} else a.out end)"
    simple = f"aggregate({found}, named_struct('at', 0, 'out', {nothing}), {merge}, a -> a.out)"
    chunks = f"transform(sequence(0, (size({found}) - 1) div {CHUNK}), c -> slice({found}, c * {CHUNK} + 1, {CHUNK}))"
    starts = f"aggregate({chunks}, array(0), (a, ch) -> concat(a, array(element_at(a, -1) + aggregate(ch, 0, (b, x) -> b + x.p + x.n))))"
    chunked = f"flatten(zip_with({chunks}, slice({starts}, 1, (size({found}) - 1) div {CHUNK} + 1), (ch, st) -> aggregate(ch, named_struct('at', st, 'out', {nothing}), {merge}, a -> a.out)))"
    return f"case when size({found}) = 0 then {nothing} when size({found}) <= {CHUNK} then {simple} else {chunked} end"


def _ruled_out(kind: str) -> str:
    """What no personal datum of the kind looks like, for a candidate ``c`` with ``near``, the text before it."""
    d = _digits("c.m")
    if kind == "email":
        return "not c.m rlike '[A-Za-z]{2,}$'"
    if kind == "ip":
        octets = f"exists(split(c.m, '[.,]'), p -> cast(p as int) > 255)"
        return f"{octets} or c.m like '%,%' or near rlike '(version|release|section|chapter|v)[. ]?$' or near rlike '[0-9A-Za-z][.,]$'"
    if kind == "card":
        return f"not {_luhn(d)} or near rlike '[0-9A-Za-z.,]$'"
    return f"length({d}) not between 8 and 15 or c.m rlike '(19|20)[0-9]{{2}}[-./ ][01]?[0-9][-./ ][0-3]?[0-9]' or near rlike '[0-9A-Za-z.,]$'"


def _features(kind: str) -> str:
    """The integers of one candidate ``c``; each has a small range, and none tells the mark or check of the base pattern."""
    d = _digits("c.m")
    left = "case when near = '' then 0 when near rlike '[A-Za-z0-9]$' then 1 when near rlike '\\\\s$' then 2 else 3 end"
    right = "case when c.e >= length(t) then 0 when substring(t, c.e + 1, 1) rlike '[A-Za-z0-9]' then 1 when substring(t, c.e + 1, 1) rlike '\\\\s' then 2 else 3 end"
    tail = "least(length(regexp_extract(c.m, '([A-Za-z]*)$', 1)), 7)" if kind == "email" else "least(length(regexp_extract(c.m, '([0-9]*)$', 1)), 7)"
    # a masked '@' or dot is one separator, whatever stands for it
    groups = "least(size(split(regexp_replace(c.m, '[(\\\\[](at|dot)[)\\\\]]', '.'), '[^A-Za-z0-9]+')), 8)" if kind == "email" else f"size(split(ltrim('+(', c.m), '[^0-9]+'))"
    parts = {
        "digits": f"least(length({d}), 24)",
        "groups": f"least({groups}, 8)",
        "left": left,
        "right": right,
        "context": f"cast(near rlike '{CONTEXT[kind]}' as int)",
        "tail": tail,
    }
    return "named_struct(" + ", ".join(f"'{k}', cast({v} as int)" for k, v in parts.items()) + ")"


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with the text as ``t`` and the base spans of each kind."""
    out = docs.withColumn("t", text_or_empty().cast("string"))
    found = out.withColumns({f"found_{k}": F.expr(_matches(BASE[k], NEEDED[k])) for k in KINDS})
    return found.withColumns({f"base_{k}": F.expr(_placed(f"found_{k}", _valid(k, "x.m"))) for k in KINDS}).drop(*[f"found_{k}" for k in KINDS])


def with_candidates(based: DataFrame) -> DataFrame:
    """Adds each kind's candidates with features, whether they meet a base span of the kind, or of any, and whether something rules them out."""
    meets = "exists(base_{}, b -> b.s < c.e and c.s < b.e)".format
    any_kind = " or ".join(meets(k) for k in KINDS)
    found = based.withColumns({f"found_{k}": F.expr(_matches(LOOSE[k], LIKELY[k])) for k in KINDS})
    loose = found.withColumns({f"loose_{k}": F.expr(_placed(f"found_{k}", "true")) for k in KINDS})
    near = f"lower(substring(t, greatest(c.s - {AROUND} + 1, 1), least(c.s, {AROUND})))"
    seen = loose.withColumns({f"seen_{k}": F.expr(f"transform(loose_{k}, c -> named_struct('s', c.s, 'e', c.e, 'm', c.m, 'near', {near}))") for k in KINDS})
    told = {f"cand_{k}": F.expr(f"transform(seen_{k}, c -> named_struct('s', c.s, 'e', c.e, 'm', c.m, 'f', {_features(k).replace('near', 'c.near')}, 'own', {meets(k)}, 'met', {any_kind}, 'out', {_ruled_out(k).replace('near', 'c.near')}))") for k in KINDS}
    return seen.withColumns(told).drop(*[f"{x}_{k}" for x in ("found", "loose", "seen") for k in KINDS])


class Booster:
    """Boosted depth-two trees over weighted integer rows, and the threshold of the wanted precision."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int, float, bool]]):
        features = np.array([f for f, *_ in rows], np.int64).reshape(len(rows), len(FEATURES))
        label, weight = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
        held = np.array([r[3] for r in rows], bool)
        x, y, n = features[~held], label[~held], weight[~held]
        positive, total = float((y * n).sum()), float(n.sum())
        self.trees: list = []
        self.start, self.threshold = 0.0, math.inf
        if not positive or positive == total:
            return
        self.start = math.log(positive / (total - positive))
        margin = np.full(len(x), self.start)
        for _ in range(ROUNDS):
            chance = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, (y - chance) * n, chance * (1 - chance) * n, 2)
            self.trees.append(tree)
            margin += self._leaves(tree, x)
        margin = self.start + sum(self._leaves(t, features[held]) for t in self.trees)
        order = np.argsort(-margin, kind="stable")
        margin, right = margin[order], np.cumsum((label * weight)[held][order])
        good = right >= PRECISION * np.cumsum(weight[held][order])
        if len(margin):
            good &= np.append(margin[1:] < margin[:-1], True)  # ties are taken or left together
            if good.any():
                self.threshold = float(margin[np.flatnonzero(good)[-1]])

    def _grow(self, x, pull, bend, depth):
        g, h = pull.sum(), bend.sum()
        best = None
        for k in range(len(FEATURES) if depth and len(x) else 0):
            below_g, below_h = (np.cumsum(np.bincount(x[:, k], v))[:-1] for v in (pull, bend))
            gain = below_g**2 / (below_h + 1) + (g - below_g) ** 2 / (h - below_h + 1) - g * g / (h + 1)
            if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0]):
                best = float(gain.max()), k, int(gain.argmax()) + 1
        if best is None:
            return float(RATE * max(-4.0, min(4.0, g / (h + 1.0))))
        _, k, cut = best
        low = x[:, k] < cut
        return k, cut, self._grow(x[low], pull[low], bend[low], depth - 1), self._grow(x[~low], pull[~low], bend[~low], depth - 1)

    def _leaves(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] < tree[1], self._leaves(tree[2], x), self._leaves(tree[3], x))

    def sql(self, f: str) -> str:
        def spelled(tree):
            if not isinstance(tree, tuple):
                return f"{tree!r}D"
            return f"case when {f}.{FEATURES[tree[0]]} < {tree[1]} then {spelled(tree[2])} else {spelled(tree[3])} end"

        return " + ".join([f"{self.start!r}D", *(f"({spelled(t)})" for t in self.trees)])


def fit(docs: DataFrame) -> dict[str, Booster]:
    """One booster a kind, from the feature counts over all documents."""
    seen = with_candidates(with_base(docs.select("text")))
    tagged = " , ".join(f"transform(cand_{k}, c -> named_struct('kind', '{k}', 'f', c.f, 'own', c.own, 'out', c.out and not c.met, 'held', pmod(xxhash64(c.m), 5) = 0))" for k in KINDS)
    every = seen.where(" or ".join(f"size(cand_{k}) > 0" for k in KINDS)).select(F.expr(f"explode(concat({tagged}))").alias("c"))
    rows = every.where("c.own or c.out").groupBy("c.kind", "c.f", "c.own", "c.held").agg(F.count("*").alias("n")).collect()
    by: dict[str, list] = {k: [] for k in KINDS}
    for r in sorted(rows, key=str):
        by[r["kind"]].append((tuple(r["f"]), int(r["own"]), r["n"] * (1.0 if r["own"] else CHANCE.get(r["kind"], 1.0)), r["held"]))
    return {k: Booster(by[k]) for k in KINDS}


def find_pii(docs: DataFrame, boosters: dict[str, Booster] | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: maps from kind to arrays of (s, e, m) in text order."""
    boosters = boosters or fit(docs)
    seen = with_candidates(with_base(docs))
    parts = {}
    for k, model in boosters.items():
        if math.isinf(model.threshold):
            parts[k] = f"base_{k}"
            continue
        chosen = f"filter(cand_{k}, c -> not c.met and not c.out and ({model.sql('c.f')}) >= {model.threshold!r}D - 1e-9D)"
        added = f"transform({chosen}, c -> named_struct('s', c.s, 'e', c.e, 'm', c.m))"
        parts[k] = f"case when exists(cand_{k}, c -> not c.met and not c.out) then array_sort(concat(base_{k}, {added}), (x, y) -> x.s - y.s) else base_{k} end"
    scored = seen.withColumns({f"all_{k}": F.expr(parts[k]) for k in KINDS})
    base = F.expr("map(" + ", ".join(f"'{k}', base_{k}" for k in KINDS) + ")")
    spans = F.expr("map(" + ", ".join(f"'{k}', all_{k}" for k in KINDS) + ")")
    return scored.select(*docs.columns, base.alias("base"), spans.alias("spans"))


def spelled(column: str) -> str:
    """kind:start:end of every span, by kind and start, comma-joined."""
    parts = ", ".join(f"transform({column}['{k}'], b -> concat('{k}:', b.s, ':', b.e))" for k in KINDS)
    return f"array_join(concat({parts}), ',')"


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, and the count of all spans."""
    found = find_pii(docs.select("doc_id", "text"))
    counts = [F.expr(f"cast(size(base['{k}']) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(spelled("base")).cast("binary"), 256).alias("base_sha256"), F.expr(spelled("spans")).alias("spans"), F.expr("cast(" + " + ".join(f"size(spans['{k}'])" for k in KINDS) + " as long)").alias("n_spans"))
