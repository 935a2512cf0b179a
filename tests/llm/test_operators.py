"""Each operator against a brute-force version on edge cases, and on an empty table and clashing columns."""

import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from cartoflow.llm import exact_dedup, fingerprints, graph, langid, lm_score, mixing, ngram_join, packing, pii, queries, suffix_dedup, token_counts
from cartoflow.llm.common import staged, staged_count
from cartoflow.llm.suffix_array import suffix_array

SPACE = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PICK = ["doc_id", "text", "lang", "source", "n_chars"]


def sized(docs):
    return staged(docs.select("doc_id", "source", mixing.words().alias("size")), "sizes")


OPERATORS = {
    "pii": pii.digest,
    "mixing": lambda d: mixing.mix(sized(d)),
    "exact": exact_dedup.exact_dedup,
    "fingerprints": fingerprints.fingerprints,
    "lm": lm_score.lm_scores,
    "suffix": suffix_dedup.remove_repeats,
    "packing": lambda d: packing.pack(d, queries.tokenizer_path("byte_bpe_50k.json")),
    "jaccard": ngram_join.jaccard_components,
    "langid": langid.identify,
    "tokens": lambda d: token_counts.token_counts(d, queries.tokenizer_path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(docs, clash, name):
    drop = ["sequence_id", "offset"] if name == "packing" else []
    a, b = (sorted(map(str, OPERATORS[name](d).drop(*drop).collect())) for d in (docs, clash))
    assert len(a) == len(b) and (name == "packing" or a == b)


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "packing"])
def test_one_row_per_document(docs, name):
    got = OPERATORS[name](docs).select("doc_id").toPandas().doc_id
    assert sorted(got.fillna(-1)) == sorted(docs.select("doc_id").toPandas().doc_id.fillna(-1))


def test_exact_dedup(docs, texts):
    groups = collections.defaultdict(list)
    for i, t, *_ in texts:
        groups[re.sub(SPACE, " ", t or "")].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()]
        assert len(mine) == len(ids) and sum(r.kept for r in mine) == 1
        assert all(r.group_size == len(ids) and r.keep_id == (min(known) if known else None) for r in mine)
        assert next(r for r in mine if r.kept).doc_id == (min(known) if known else None)


def test_exact_dedup_across_partitions(spark):
    many = spark.range(400).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text' else concat('t ', id % 50) end as text").repartition(9)
    got = exact_dedup.exact_dedup(many).collect()
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert {r.keep_id for r in got if r.group_size == 134} == {0}


def test_mixing(docs, texts):
    got = mixing.mix(sized(docs)).collect()
    total = sum(len(WORD.findall(t or "")) for _, t, *_ in texts)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    assert math.isclose(sum(rows[0].target for rows in by.values()), total, rel_tol=1e-9)
    for rows in by.values():
        size = sum(r.size for r in rows)
        assert rows[0].source_size == size and rows[0].target <= 3 * size + 1e-6
        assert all(r.taken <= 3 * r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max((r.size for r in rows), default=0)
    again = mixing.mix(sized(docs)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_water_level(spark):
    rows = [(s, f"+{s}", size, 1) for s, size in (("a", 10), ("b", 100), ("c", 50), ("d", 1000))]
    cells = spark.createDataFrame(rows, "source string, __source_key string, size long, n long")
    got = {r.source: r.target for r in mixing.targets(cells).collect()}
    want, fixed = {}, {}
    sizes, weights = {"a": 10, "b": 100, "c": 50, "d": 1000}, {"a": 5, "b": 2, "c": 1, "d": 5}
    while True:
        rest = 1160 - sum(fixed.values())
        free = {s: w for s, w in weights.items() if s not in fixed}
        want = fixed | {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s: 3.0 * sizes[s] for s in free if want[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    assert got == pytest.approx(want)


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path).toPandas()
    want = collections.Counter()
    for i, t, *_ in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want[(-1 if i is None else i, len(ids))] += 1
    seen = collections.Counter()
    for (i, n), rows in got.fillna({"doc_id": -1}).groupby(["doc_id", "doc_tokens"]):
        assert rows.length.sum() == n * want[(i, n)]
        seen[(i, n)] = want[(i, n)]
    assert seen == want
    byid = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in texts if i is not None}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        piece = np.array(byid[int(r.doc_id)][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.length.sum() <= 1024 and (rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]])


def test_differencing_beats_greedy_bound():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 257, 300)
    part, parts = packing.split_pool(sizes, 1024)
    sums = np.bincount(part, sizes, parts)
    assert sums.max() <= 1024 and parts - math.ceil(sizes.sum() / 1024) <= 1 and sums.max() - sums.min() < 64


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def test_jaccard_components(docs, texts):
    sets = [(i, shingles(t)) for i, t, *_ in texts]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = collections.Counter()
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    names = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        names[find(k)].append(i)
    want = sorted(str((i, len(s), min((x for x in names[find(k)] if x is not None), default=None), links[k])) for k, (i, s) in enumerate(sets))
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.n_links)) for r in ngram_join.jaccard_components(docs).collect())
    assert got == want


@pytest.mark.parametrize(("block", "width", "num"), [(2, 3, 90), (512, 3, 90), (2, 5, 80), (512, 5, 80)])
def test_jaccard_finds_every_link_of_random_near_copies(spark, monkeypatch, block, width, num):
    import random

    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "WIDE", 2 * block)
    rng = random.Random(5)
    rows = []
    for family in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 20, 45, 160, 400]))]
        for _ in range(9):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 50))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.jaccard_components(df, width, num).collect()}
    sets = {i: frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) for i, t in rows for w in [t.split()]}
    link = {i: {j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])} for i in sets}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == (min(seen), len(link[i]))


def test_language_id_holds_out_and_refuses(spark, docs):
    rows = [(k, {"en": "the cat sat on the mat with cheese", "fr": "le chat mange du fromage avec élan"}[lang] + f" {k}", lang) for k in range(300) for lang in [("en", "fr")[k % 2]]]
    df = spark.createDataFrame([*rows, (1000, "12345 !!!", "en"), (1001, None, "fr"), (1002, "cheeses matting", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got.values())


def test_language_id_accuracy_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs).where("held_out").join(docs, "doc_id").where("text is not null and lang is not null")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()


def test_token_counts_equal_the_unigram_tokenizer(docs, texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.tokenizer_path("piece_bpe_32k.model")
    vocabulary = [("<unk>", 0.0), *token_counts.read_vocabulary(path), *[(f"<0x{b:02X}>", 0.0) for b in range(256)]]
    lowest = min(s for _, s in vocabulary)
    vocabulary = [(p, lowest if p.startswith("<0x") or p == "<unk>" else s) for p, s in vocabulary]
    exact = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    got = collections.Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, path).collect())
    assert got == collections.Counter((i, len(exact.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in texts)


def test_language_model(docs, texts):
    rows = [(i, [*WORD.findall((t or "").translate(LOWER)), None], zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0) for i, t, *_ in texts]
    count = collections.Counter(w for _, ws, held in rows if not held for w in ws)
    total, different = sum(count.values()), len(count)
    base = [(i, held, len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (different + 1))) for w in ws), 5)) for i, ws, held in rows]
    got = lm_score.lm_scores(docs).collect()
    assert sorted(map(str, base)) == sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))) for r in got)


@pytest.mark.parametrize("share", [1e-6, 0.02, 0.9])
def test_language_model_keeps_what_occurs_twice(docs, texts, share):
    """Scores are those of every n-gram that occurs twice, whatever share of the corpus is broadcast."""
    rows = [(i, [*WORD.findall((t or "").translate(LOWER)), None], zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0) for i, t, *_ in texts]
    count = collections.Counter(tuple(ws[j : j + n]) for _, ws, held in rows if not held for n in (1, 2, 3) for j in range(len(ws) - n + 1))
    total, different = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)
    kept = {g: c for g, c in count.items() if len(g) > 1 and c >= 2}
    after = collections.defaultdict(list)
    for g in kept:
        after[g[:-1]].append(g[-1])

    def p(context, word):
        if not context:
            return (count[word,] + 0.1) / (total + 0.1 * (different + 1))
        if (*context, word) in kept:
            return (kept[*context, word] - 0.5) / count[context]
        return back(context) * p(context[1:], word)

    @functools.cache
    def back(context):
        if context not in after:
            return 1.0
        return max(1 - sum(p(context, w) for w in after[context]), 1e-12) / max(1 - sum(p(context[1:], w) for w in after[context]), 1e-12)

    want = [(i, round(sum(math.log10(p(tuple(ws[max(j - 2, 0) : j]), w)) for j, w in enumerate(ws)), 4)) for i, ws, _ in rows]
    got = [(r.doc_id, round(r.score, 4)) for r in lm_score.lm_scores(docs, share=share).collect()]
    assert sorted(map(str, want)) == sorted(map(str, got))


def test_language_model_moves_little(spark):
    """What is shuffled is a small multiple of the texts: keys of each block travel once a level, not each occurrence."""
    rng = np.random.default_rng(3)
    words = np.array([f"word{i}" for i in range(3000)])
    made = [(i, " ".join(words[np.minimum(rng.zipf(1.3, 1000), 3000) - 1])) for i in range(300)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(2).localCheckpoint()

    def written():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    assert len(lm_score.lm_scores(docs).collect()) == len(made)
    moved = (written() - before) / sum(len(t) for _, t in made)
    assert moved < 1.6, moved


def test_automaton_is_a_distribution():
    """The continuations of every state add up to one, and the walk equals step-by-step backoff."""
    rng = np.random.default_rng(0)
    stream = rng.integers(0, 6, 4000)
    hashes = (stream + 10).astype(np.uint64)
    at = np.arange(0, 4001, 40)
    words, counts = np.unique(hashes, return_counts=True)
    model = lm_score.Automaton(words, counts, len(hashes), len(words))
    word = model.word_ids(hashes)
    for _ in range(2):
        keys, found = np.unique(model.longer(word, at), return_counts=True)
        model.add_level(keys[found >= 3], found[found >= 3])
    unknown = math.log10(lm_score.ALPHA / model.norm)
    for state in range(len(model.back)):
        gain, _ = model.step(np.full(7, state), np.array([0, 1, 2, 3, 4, 5, -1]))
        gain[-1] += unknown
        assert (10.0**gain).sum() == pytest.approx(1.0, abs=1e-9) or model.state_count[state] < 60
    scores = model.score(word, at)
    state, slow = np.zeros(1, np.int64), 0.0
    for w in word[:40]:
        gain, state = model.step(state, np.array([w]))
        slow += gain[0]
    assert scores[0] == pytest.approx(slow)


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(1, rng.integers(2, 5), rng.integers(1, 50))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("most", [0, 2500])
def test_repeat_removal(spark, docs, texts, monkeypatch, most):
    """Suffix-sorted classes, and the way for classes that are too wide."""
    monkeypatch.setattr(suffix_dedup, "MOST_BLOCKS", most)
    width = 400
    data = [(i, (t or "").encode()) for i, t, *_ in texts]
    starts = collections.Counter(b[s : s + width] for _, b in data for s in range(len(b) - width + 1))
    want = []
    for i, b in data:
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - width + 1):
            if starts[b[s : s + width]] > 1:
                cover[s] += 1
                cover[s + width] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append(str((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())))
    got = [str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)


def luhn(digits):
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 8 <= len(d) <= 15}[kind]
            if good():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, docs, texts):
    odd = [
        "mail a.b@c.d_e@f.gh x@y z@@w.v @q.r é@ü.de 😀 joe@mail.example.com.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 010.020.030.040 1..2.3.4",
        "4465758382889437 4465 7583-8288 9437 44657583828894370 1 2 3 4 5 6", "+1 (743) 555-3824 +49-30-1234567. +1 2 +123", "x" * 3000 + "@" + "y" * 50 + ".com", "1 " * 3000, "+" * 200, None,
    ]
    rows = [(100 + k, t, "en", "a", 0) for k, t in enumerate(odd)]
    df = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    got = {(r.doc_id, r.base_sha256): r for r in pii.digest(df).collect()}
    for i, t, *_ in [*texts, *rows]:
        want = base_spans(t)
        r = got[(i, hashlib.sha256(",".join(want).encode()).hexdigest())]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(r.spans.split(","))


def test_fingerprints(docs, texts):
    got = fingerprints.fingerprints(docs).collect()
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = collections.Counter()
    for (i, t, *_), (_, after, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        want[(i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.fingerprint)
    assert by[5] == by[6] and by[7] != by[10]


def test_parsing_is_locally_consistent():
    """A shared substring keeps its interior phrases at any offset."""
    rng = np.random.default_rng(0)
    shared = rng.integers(97, 123, 4000, dtype=np.uint8).tobytes()
    a, b = (rng.integers(97, 123, n, dtype=np.uint8).tobytes() + shared for n in (17, 1203))

    def names(data):
        flat = np.frombuffer(data, np.uint8)
        symbols, values, starts = flat, flat.astype(np.uint64), np.array([0])
        for _ in range(2):
            values, starts = fingerprints._level(symbols, values, starts)
            symbols = values
        return set(values.tolist())

    x, y, z = names(a), names(b), names(shared)
    assert len(x & y) > 0.95 * len(z)


def test_mixing_tilts_by_size(spark):
    """Within a source rates are the capped exponential of the size: short documents of a reduced source stay, long ones go."""
    rows = [(k, source, 10 + 7 * (k % 40)) for source in ("a", "b", "c") for k in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    for _, of in got.groupby("source"):
        rate = of.groupby("size").rate.first()
        free = rate[(rate < 3) & (rate > 1e-3)]
        assert len(free) > 5 and rate.nunique() > 5
        slope = np.log(free.to_numpy()) / free.index.to_numpy()
        assert np.allclose(slope, slope.mean(), rtol=1e-3)
        assert of.taken.sum() == pytest.approx(of.target.iloc[0], rel=1e-3)


def test_language_id_letters():
    """Numbers that look like letters are none; every Unicode letter is."""
    assert langid._LETTERS.findall("½ ² Ⅷ ① 12 _ !") == []
    assert langid._LETTERS.findall("straße 漢字 a1b x²y ªº") == ["straße", "漢字", "a", "b", "x", "y", "ªº"]


def test_language_id_equals_brute_force(spark):
    """Every word and n-gram of the training rows counts, words first, then the longest known n-grams."""
    words = {"en": "cheese cat house water the bread", "fr": "fromage chat maison eau le pain", "de": "katze haus wasser das brot und"}
    rows = [(k, " ".join(w for j, w in enumerate(words[lang].split()) if (k >> j) & 1 or j == k % 6) + f" {lang}x{k}", lang) for k in range(90) for lang in [sorted(words)[k % 3]]]
    rows += [(900, "cheesecat maisonette", None), (901, "wasserhaus qqq", None), (902, "zz", None)]
    train = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    langs, pattern = sorted(words), re.compile(r"[^\W\d_]+")

    def grams(w, n):
        return [w] if n == 0 else list(w) if n == 1 else [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]

    count = [collections.Counter((lang, g) for t, lang in train for w in pattern.findall(t.lower()) for g in grams(w, n)) for n in range(6)]
    seen = [{g for _, g in c} for c in count]
    floor = [[math.log(sum(c for (x, _), c in count[n].items() if x == lang) + 0.5 * len(seen[n])) for lang in langs] for n in range(6)]

    def value(n, g):
        return np.array([math.log(count[n][lang, g] + 0.5) - floor[n][k] for k, lang in enumerate(langs)])

    def word(w):
        for n in (0, 5, 4, 3, 2, 1):
            known = [g for g in grams(w, n) if g in seen[n]]
            if known:
                return sum(value(n, g) for g in known) / len(known)
        return np.zeros(3)

    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        total = sum((word(w) for w in pattern.findall(t.lower())), np.zeros(3))
        assert got[i].lang_pred == langs[int(total.argmax())]
        assert got[i].score == pytest.approx(float(1 / np.exp(total - total.max()).sum()), rel=1e-4)


def test_personal_data_added_spans(spark):
    """What the trees add, against candidates, features and trees in plain Python."""
    import random

    rng = random.Random(3)

    def card(valid):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(f"{body}{c}" for c in "0123456789" if luhn(f"{body}{c}") == valid)

    texts = []
    for k in range(240):
        texts += [f"please pay card {card(True)} today", f"item number.{card(False)}", "pay card " + ".".join(re.findall("....", card(True))) + " ok", f"write to mail joe{k}@site{k}.org now", f"ratio {k} @ 1.{k} here", f"contact mail ann{k} (at) host{k} (dot) net soon"]
        texts += [f"host server 10.{k % 250}.3.{k % 200} up", f"version 1.{k}.3.999 out", f"call phone +49 30 12{k:04d}9 or", f"fax 00{k % 90 + 10} 3045 1234 5678 x", f"on 2024-01-{k % 28 + 1:02d} 10 30"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    models = pii.fit(df)
    got = {r.doc_id: r.spans for r in pii.digest(df).select("doc_id", "spans").collect()}

    def features(kind, text, m):
        near, after = text[max(m.start() - pii.AROUND, 0) : m.start()].lower(), text[m.end() : m.end() + 1]
        side = lambda c: 0 if not c else 1 if re.match("[A-Za-z0-9]", c) else 2 if re.match(r"\s", c) else 3
        flat = re.sub(r"[(\[](at|dot)[)\]]", ".", m[0]) if kind == "email" else m[0].lstrip("+(")
        groups = re.split("[^A-Za-z0-9]+" if kind == "email" else "[^0-9]+", flat)
        tail = re.search("([A-Za-z]*)$" if kind == "email" else "([0-9]*)$", m[0])[1]
        return near, [min(len(re.sub("[^0-9]", "", m[0])), 24), min(len(groups), 8), side(near[-1:]), side(after), int(bool(re.search(pii.CONTEXT[kind], near))), min(len(tail), 7)]

    def out(kind, s, near):
        d = re.sub("[^0-9]", "", s)
        if kind == "email":
            return not re.search("[A-Za-z]{2,}$", s)
        if kind == "ip":
            return any(int(p) > 255 for p in re.split("[.,]", s)) or "," in s or bool(re.search(r"(version|release|section|chapter|v)[. ]?$|[0-9A-Za-z][.,]$", near))
        if kind == "card":
            return not luhn(d) or bool(re.search("[0-9A-Za-z.,]$", near))
        return not 8 <= len(d) <= 15 or bool(re.search("(19|20)[0-9]{2}[-./ ][01]?[0-9][-./ ][0-3]?[0-9]", s)) or bool(re.search("[0-9A-Za-z.,]$", near))

    added = collections.Counter()
    for i, text in enumerate(texts):
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(text))]
        want = list(base)
        for kind in pii.KINDS:
            for m in re.finditer(pii.LOOSE[kind], text):
                near, f = features(kind, text, m)
                if any(a < m.end() and m.start() < b for _, a, b in base) or out(kind, m[0], near):
                    continue
                model = models[kind]
                if model.start + sum(model._leaves(t, np.array([f]))[0] for t in model.trees) >= model.threshold - 1e-9:
                    want.append((kind, m.start(), m.end()))
                    added[kind] += 1
        want.sort(key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
    assert added["email"] == 240 and added["card"] == 240 and not any("version" in texts[i] for i, x in got.items() if x)


def test_parity_bitmaps_bound_the_difference():
    """No similar pair is ruled out, whatever the sizes, and most unrelated ones are."""
    rng = np.random.default_rng(4)
    sets = []
    for size in (5, 40, 70, 120, 130, 300, 700):
        base = rng.integers(1, 1 << 62, size, dtype=np.uint64)
        for share in (0, 0, 0.02, 0.05, 0.1, 0.3, 1):
            some = base[rng.random(size) >= share]
            sets.append(np.unique(np.concatenate([some, rng.integers(1, 1 << 62, int(size * share / 2), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sizes = np.diff(offsets)
    close = ngram_join.close_pairs(ngram_join.parity(np.concatenate(sets), offsets), sizes, 80, 100)
    n = len(sets)
    true = np.array([[i != j and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (close | ~true).all() and true.sum() > n and close.sum() < 4 * true.sum()


@pytest.mark.parametrize("most", [0, 150, 10**6])
def test_components_of_paths_and_cycles(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MOST_ALONE", most)
    rng = np.random.default_rng(2)
    names = rng.permutation(10**6)[:400] - 500_000
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[200 + i], names[200 + (i + 1) % 100]) for i in range(100)] + [(names[i], names[i]) for i in range(300, 310)]
    before = staged_count()
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long").repartition(5)).collect()}
    assert got == {int(x): int(min(part)) for part in (names[:200], names[200:300]) for x in part}
    # rounds write a table each
    assert most < 10**6 or staged_count() - before == 1


def test_common_passages_do_not_make_one_unit(spark, monkeypatch):
    """Documents made of a few common passages and words of their own share signatures, but no rare shingle of a prefix."""
    import random

    compared = []
    wide = ngram_join._close
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "_close", lambda *a: compared.append(a) or wide(*a))
    rng = random.Random(8)
    passages = [[f"p{k}x{i}" for i in range(60)] for k in range(4)]
    rows = []
    for i in range(60):
        own = [f"own{i}x{j}" for j in range(25)]
        rows.append((i, " ".join([*rng.choice(passages), *own])))
    for i in range(6):
        words = rows[i * 9][1].split()
        rows.append((len(rows), " ".join([*words[:-1], "changed"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.jaccard_components(df, 5, 80).collect()}
    copied = {i * 9: 60 + i for i in range(6)}
    assert got == {i: (i, int(i in copied)) for i in range(60)} | {copy: (i, 1) for i, copy in copied.items()}
    assert not compared


def test_verifying_a_small_unit_takes_little_memory():
    import tracemalloc

    rows = [np.arange(k, 300 + k, dtype=np.uint64) for k in range(3)]
    tracemalloc.start()
    link = ngram_join.linked(rows, np.array([300, 300, 300]), 80, 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert link.sum() == 6 and most < 1_000_000
