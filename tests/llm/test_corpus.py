"""BPE, SimHash, decontamination, language model, sharding and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from agvlens.llm import bpe, lm, sharding, simhash, templates
from agvlens.llm.components import components
from agvlens.llm.gru import Model, Shape, start_weights
from pyspark.sql import functions as F

TEXTS = [None, "", "Hello world", "  a\n\n b  ", "<|endoftext|>x<|endoftext|>", "漢字と🙂 don't I'LL", "x" * 700 + "é" * 300, "\x85　\x1c1²Ⅷ", "=-" * 300, "word " * 70_000]


def test_bpe_equals_the_library(documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    got = {r["doc_id"]: r for r in bpe.round_trip(documents(*TEXTS, extra=True), bpe.vocabulary_path(), tuple(bpe.OUTPUTS)).collect()}
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["decoded"] == text and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(documents("a").limit(0), bpe.vocabulary_path()).count() == 0


def test_covering_masks_meet_every_pair():
    dice, masks = np.random.default_rng(3), simhash.masks()
    for _ in range(2000):
        gap = sum(1 << int(i) for i in dice.choice(64, 3, replace=False))
        assert any(not gap & m for m in masks)


def brute_components(prints):
    root = {f: f for f in prints}
    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in root}


@pytest.mark.parametrize("limit", [1, 64])
def test_simhash_components(documents, prose, limit):
    base = prose(1, 400).split()
    texts = [prose(2, 5), None, "", "The Cat", "the cat", "the\tcat"] + [" ".join(base[:i] + ["new"] + base[i + 1:]) for i in range(0, 40)] + [prose(2, 5)]
    docs = documents(*[(t, "en", "a", None if i == 3 else i) for i, t in enumerate(texts)])
    plain = {}
    for i, t in enumerate(texts):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        plain[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    roots = brute_components(set(plain.values()))
    ids = {i: (None if i == 3 else i) for i in plain}
    least = {r: min((ids[i] for i in plain if roots[plain[i]] == r and ids[i] is not None), default=None) for r in set(roots.values())}
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(docs, list_limit=limit).collect()), key=str)
    assert got == sorted(((ids[i], plain[i], least[roots[plain[i]]]) for i in plain), key=str)
    kept = simhash.keep_first(docs, list_limit=limit)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_each_class_in_crowded_buckets(documents, prose):
    """900 documents around one text, 6 of 400 words changed in each: buckets far over the limit lose no link."""
    dice, base = np.random.default_rng(8), prose(77, 400).split()
    texts = []
    for i in range(900):
        words = list(base)
        for at in dice.choice(400, 6, replace=False):
            words[at] = f"new{i % 450}"
        texts.append(" ".join(words))
    prints = [simhash.fingerprint(t) for t in texts]
    roots = brute_components(set(prints))
    want = {}
    for i, f in enumerate(prints):
        want.setdefault(roots[f], i)
    docs = documents(*texts, extra=True)
    kept = simhash.keep_first(docs, list_limit=4)
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) and kept.columns == docs.columns
    assert 1 < len(want) < 890


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(1000, 1100)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 141)} | {i: 7 for i in range(1000, 1100)}


QUESTION = "Today Tom has 12 apples and Tom gives 5 apples to Sam before lunch. How many apples does Tom have left after the trade today?"


def test_leaks(spark, documents, prose):
    bench = spark.createDataFrame([(1, QUESTION), (2, prose(50, 30)), (3, None), (4, "a b")], "item_id long, text string")
    moved = QUESTION.replace("Tom", "Bob").replace("12", "40").replace("5", "9").replace("Sam", "Ann")
    torn = QUESTION.replace("Tom has 12", "Bob has 40").replace("does Tom", "does Ann")
    docs = documents(prose(1, 80), prose(2, 40) + ". " + QUESTION + " " + prose(3, 40), moved, torn, None, "", prose(4, 50) + "\n" + prose(50, 30).upper(), prose(50, 30)[:60])
    got = {(r["doc_id"], r["item_id"]): r for r in templates.leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 2)}
    assert got[2, 1]["changed"] and not got[1, 1]["changed"] and got[1, 1]["share"] == 1.0
    kept = templates.drop_leaks(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == {0, 3, 4, 5, 7} and kept.columns == docs.columns
    assert templates.leaks(docs, bench.limit(0)).count() == 0 and templates.leaks(docs.limit(0), bench).count() == 0


def plain_leaks(texts, items, m=templates.Matching()):
    """(text number, item id) by comparing all windows of all pairs, from the tokens alone."""
    words, out = templates.Words(), set()
    def read(t):
        ids, types, hashes = templates.tokens(t, words)
        return [(int(k), words.text[i]) for i, k in zip(ids, types, strict=True)]
    def template(window):
        return tuple(w if k == templates.LITERAL else k for k, w in window)
    for item_id, item in items:
        w = read(item)
        size = min(m.window, len(w))
        if not size:
            continue
        n = len(w) - size + 1
        wins = [w[i:i + size] for i in range(n)]
        loose = [size >= m.min_literals and sum(k == templates.LITERAL for k, _ in x) >= m.min_literals for x in wins]
        strict = [sum(k == templates.LITERAL for k, _ in x) < m.min_literals for x in wins]
        for t, text in enumerate(texts):
            v = read(text)
            diagonals = {}
            for p in range(len(v) - size + 1):
                own = v[p:p + size]
                for i in range(n):
                    if loose[i] and template(own) == template(wins[i]) or strict[i] and [x for _, x in own] == [x for _, x in wins[i]]:
                        at, slots = diagonals.setdefault(i - p, (set(), set()))
                        at.add(i)
                        if loose[i]:
                            slots.update((a, b) for a, b in zip(wins[i], own, strict=True) if a[0])
            steady = lambda s: len({a for a, _ in s}) == len(s)
            good = sorted((d, x) for d, x in diagonals.items() if steady(x[1]))
            bands = []
            for d, x in good:
                if bands and d - bands[-1][-1][0] <= m.drift:
                    bands[-1].append((d, x))
                else:
                    bands.append([(d, x)])
            sums = [(set().union(*(x[0] for _, x in b)), set().union(*(x[1] for _, x in b))) for b in bands]
            for at, slots in [x for _, x in good] + [x for x in sums if steady(x[1])]:
                templated = sum(loose[i] for i in at)
                if max(templated / sum(loose) if any(loose) else 0, len(at) / n) >= m.min_share:
                    out.add((t, item_id))
    return out


def test_leaks_equal_brute_force(spark, documents, prose):
    dice = np.random.default_rng(12)
    items = [(i, prose(200 + i, n)) for i, n in enumerate((36, 60, 9, 5, 8, 120))] + [(50, QUESTION), (51, "What is 12 + 34?"), (52, "Add 3 apples and 4 apples to 5 km.")]
    texts = []
    for _, item in items:
        w = item.split()
        for step in (3, 6, 9, 12, 1000):  # a word put in, or left out, after so many
            texts.append(" ".join(x for i, a in enumerate(w) for x in ([a, "xx"] if i % step == step - 1 else [a])))
            texts.append(prose(7, 20) + " " + " ".join(a for i, a in enumerate(w) if i % step != step - 1))
        cut = int(dice.integers(0, max(1, len(w) - 3)))
        texts += [" ".join(w[cut:cut + 14]), item.replace("Tom", "Bob").replace("12", "7"), item + " " + item]
    texts += [prose(300 + k, 60) for k in range(10)]
    got = {(r["doc_id"], r["item_id"]) for r in templates.leaks(documents(*texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_leaks(texts, items) and 40 < len(got) < len(texts) * len(items) / 3
    spread = items[0][1].split()  # a word after each twelve: under 30 % of the windows on any one diagonal
    torn = " ".join(x for i, a in enumerate(spread) for x in ([a, "put"] if i % 12 == 11 else [a]))
    assert templates.leaks(documents(torn), spark.createDataFrame(items[:1], "item_id long, text string")).count() == 1


def test_new_values_may_coincide(spark, documents):
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    same = QUESTION.replace("12", "9").replace("5", "9")
    split = same.replace("does Tom", "does Ann")
    got = {r["doc_id"]: r for r in templates.leaks(documents(same, split), bench).collect()}
    assert set(got) == {0} and got[0]["changed"] and got[0]["merged"] == 1 and got[0]["share"] == 1.0


def test_items_of_few_literals_are_found_exactly(spark, documents, prose):
    short = ["What is 12 + 34?", "Name Three Rivers", "Anna Berlin 1999 Boris Cairo 2003 Clara Delhi 2007 Dora Essen 2011"]
    bench = spark.createDataFrame([*enumerate(short), (3, "..."), (4, QUESTION + " " + short[2])], "item_id long, text string")
    docs = documents(*[f"{prose(9, 20)} {x.lower()} {prose(8, 20)}" for x in short], short[0].replace("12", "13"), prose(7, 40), "he said " + short[2])
    got = {(r["doc_id"], r["item_id"]): r for r in templates.leaks(docs, bench).collect()}
    assert {(d, i) for d, i in got if i < 4} == {(0, 0), (1, 1), (2, 2), (5, 2)}
    assert all(got[k]["share"] == 1.0 and not got[k]["changed"] for k in got if k[1] < 4)


def test_gradient():
    shape = Shape(classes=3, per_class=4, hidden=5, lanes=3, window=4)
    dice = np.random.default_rng(0)
    docs = [dice.integers(0, 12, 3) for _ in range(3)]
    w = start_weights(shape, np.ones(12))

    class Caught(Model):
        def step(self, grad, tokens):
            self.grad = grad

    model = Caught(shape, {k: v.copy() for k, v in w.items()})
    model.run(docs, True)
    for k in w:
        i = tuple(int(dice.integers(0, s)) for s in w[k].shape)
        up, down = ({n: v.astype(np.float64) for n, v in w.items()} for _ in range(2))
        up[k][i] += 1e-3
        down[k][i] -= 1e-3
        slope = (Model(shape, up).run(docs, False).sum() - Model(shape, down).run(docs, False).sum()) / 2e-3
        assert abs(-slope - model.grad[k][i]) < 1e-3


def test_probabilities_sum_to_one_over_next_words():
    shape = Shape(classes=2, per_class=3, hidden=4, lanes=8, window=2)
    model = Model(shape, start_weights(shape, np.arange(6)))
    scores = model.run([np.array([3, 1, w]) for w in range(6)], False)
    ends = model.run([np.array([3, 1, w, 0]) for w in range(6)], False)
    assert len(scores) == 6 and np.all(scores < 0) and np.all(ends < scores)


def test_scores_equal_a_plain_forward_pass():
    """One document at a time, one word after another, whatever the lanes and windows."""
    shape, dice = Shape(classes=3, per_class=4, hidden=5, lanes=3, window=4), np.random.default_rng(4)
    w = {k: v + dice.normal(0, 0.5, v.shape) for k, v in start_weights(shape, np.arange(12)).items()}
    docs = [dice.integers(0, 12, n) for n in (0, 1, 23, 4, 9, 3, 17, 0)]
    for d, got in zip(docs, Model(shape, w).run(docs, False), strict=True):
        h, want = np.zeros(5), 0.0
        for x, y in zip([0, *d], [*d, 0], strict=True):
            g, hu = w["x"][x] + w["b"], h @ w["u"]
            z, r = 1 / (1 + np.exp(-(g + hu)[:5])), 1 / (1 + np.exp(-(g + hu)[5:10]))
            h = z * h + (1 - z) * np.tanh(g[10:] + r * hu[10:])
            cls, inner = h @ w["wc"] + w["bc"], h @ w["ww"][y // 4] + w["bw"][y // 4]
            want += cls[y // 4] - np.log(np.exp(cls).sum()) + inner[y % 4] - np.log(np.exp(inner).sum())
        assert math.isclose(got, want, rel_tol=1e-5)


def test_network_follows_the_counts():
    counts = (1e6 / np.arange(1, 200_001)).astype(np.int64)
    for words, share in ((counts, 0.6), (counts[:5000], 0.6), (np.full(30_000, 3), 0.6), (counts, 0.4)):
        shape = lm.shape_for(words, int(words.sum()), share)
        assert words[:shape.words - 2].sum() >= share * words.sum() > 0 and shape.classes == shape.per_class
    assert lm.shape_for(counts, int(counts.sum()), 0.9).hidden > lm.shape_for(counts, int(counts.sum()), 0.4).hidden
    assert lm.shape_for(np.zeros(0, np.int64), 0, 0.6).words == 256


def test_words_beyond_the_first_254_are_told_apart(documents):
    """1,200 words of which each is followed by the next: a network that knows them needs less than their unigrams to tell a text."""
    texts = [" ".join(f"w{(7 * i + j) % 1200}" for j in range(400)) for i in range(600)]
    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 1}
    rows = [r for r in lm.score(documents(*texts), lm.Config(group_tokens=20_000)).collect() if r["doc_id"] in held]
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert gain > 0.6  # 0.5 with 254 words


def test_scores(documents, prose):
    common = ["the of and to in a is it was for"] * 30
    texts = [None, "", "Zebra quagga"] + [f"{t} {prose(i, 12)}" for i, t in enumerate(common)] * 2
    docs = documents(*texts)
    words = {i: [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(), "\n"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in lm.score(docs, lm.Config(dictionary=20)).collect()}
    for i, ws in words.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held[i], len(ws), total, sum(counts[w] > 0 for w in ws))
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lm.score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_bytes", [200, 1 << 28])
def test_shards(spark, documents, tmp_path, bucket_bytes):
    texts = ["x" * (i * 7 % 90) for i in range(150)]
    rows = [(t, "en", "a", i) for i, t in enumerate(texts)] + [("same", "en", "a", 77)] * 60 + [(None, "en", "a", None)] * 3 + [("", "en", "a", 500 + i // 9) for i in range(200)]
    docs = documents(*rows).withColumn("slot", F.lit("clash")).withColumn("size", F.lit(-1))
    got = sharding.sharded(docs, n_shards=4, bucket_bytes=bucket_bytes).collect()
    want = Counter((i, t, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t, _, _, i in rows)
    assert Counter((r["doc_id"], r["text"], r["size"], r["text_crc32"]) for r in got) == want
    assert set(got[0].asDict()) == {*docs.columns, *sharding.RESULT}
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(loads) - min(loads) <= 2 * 98 and {r["law"] for r in got} == {"bytes"}
    last = -1
    for s in range(4):
        mine = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in mine]
        assert keys == sorted(keys) and keys[0] >= last
        last = keys[-1]
    assert sharding.shards(documents("a").limit(0)).count() == 0
    path = str(tmp_path / "shards")
    sharding.write_shards(documents(*rows), path, n_shards=4)
    assert spark.read.parquet(path).count() == len(rows) and len(list((tmp_path / "shards").glob("shard=*"))) == 4


def test_shards_of_one_text_and_of_a_long_one(documents):
    same = sharding.shards(documents(*[("copy", "en", "a", 5)] * 400), n_shards=8).collect()
    assert Counter(r["shard"] for r in same) == Counter({s: 50 for s in range(8)})
    long = sharding.shards(documents("y" * 300_000, *["z" * 50] * 300), n_shards=3).collect()
    assert len(long) == 301 and len({(r["shard"], r["slot"]) for r in long}) == 301


def test_pipeline_stages(spark, tmp_path, documents, prose):
    import corpus_pipeline

    clean = [(prose(i, 80), "en", "a") for i in range(60)]
    leak = prose(500, 40)
    docs = documents(*clean, clean[0], ("short", "en", "a"), (prose(71, 40) + "\n" + leak, "en", "a"), (None, None, None))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == set(range(60))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "tokenize"]


#: Names that operators use for columns of their own, and one that needs quoting.
CLASHING = ("n_lines", "n_dropped", "doc", "digest", "id", "fp", "r", "__r", "__digest", "__key", "site", "body", "stats", "kept", "pool", "x0", "a.b")


def test_stages_leave_other_columns_alone(spark, documents, prose):
    from agvlens.llm import line_dedup, quality

    leak = prose(500, 40)
    docs = documents(*[(prose(i, 60) + "\nMenu", "en", "a") for i in range(8)], (prose(3, 60) + "\nMenu", "en", "a", 3), (leak, "en", "a", None), (None, None, None, None))
    docs = docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING])
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    stages = {"quality": quality.keep_good(docs), "lines": line_dedup.document_lines(docs), "copies": simhash.keep_first(docs), "leaks": templates.drop_leaks(docs, bench)}
    counts = {}
    for name, out in stages.items():
        assert out.columns == docs.columns, name
        rows = out.collect()
        counts[name] = len(rows)
        assert all(r[c] == f"{c} {'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHING), name
    assert counts == {"quality": 10, "lines": 11, "copies": 10, "leaks": 10}
