"""The numbered operators on small tables: edge cases, and brute force where SQL has no form."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm import (
    components,
    embedding_dedup,
    language_id,
    language_model,
    packing,
    quality_model,
    quality_rules,
    sentencepiece_scan,
    simhash,
    suffix_dedup,
    token_files,
    tokens,
)

#: Names that the operators use inside.
CLASHES = ["k", "h", "fp", "_row", "_words", "data", "shard", "ids", "bucket", "lang", "s"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def table(spark, rows):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(c, T.StringType()) for c in CLASHES]
    return spark.createDataFrame([(i, t, *["x"] * len(CLASHES)) for i, t in rows], T.StructType(fields))


def rows():
    passage = text(99, 60)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, text(4, 80)),
        (5, text(4, 80)),
        (6, text(4, 80) + " more"),
        (7, text(7, 30) + " " + passage + " " + text(8, 20)),
        (8, text(9, 25) + " " + passage + " " + text(10, 40)),
        (9, "Ünïcödé wörds — and 漢字 " * 30),
        (10, text(11, 20000)),
        (11, "a" * 3000),
        (12, "one\none\ntwo # $ %"),
        (12, "one\none\ntwo # $ %"),
        (None, "no key " * 20),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, rows()).repartition(3).cache()


def test_rules(spark, docs):
    got = quality_rules.ledger(docs).toPandas()
    assert len(got) == len(rows())
    by = got.set_index("doc_id")
    assert by.loc[1, "n_words"] == 0 and by.loc[3, "n_lines"] == 0
    assert by.loc[12, "n_dup_lines"].tolist() == [1, 1] and by.loc[12, "n_symbols"].tolist() == [3, 3]
    for i, t in rows():
        if i is None or i == 12:
            continue
        w = [x for x in (t or "").encode().split()]
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        many = {g for g in grams if grams.count(g) > 1} if len(w) < 2000 else None
        if many is not None:
            covered = {j + o for j, g in enumerate(grams) if g in many for o in range(3)}
            assert by.loc[i, "n_repeat_words"] == len(covered), i
    kept = quality_rules.keep_passing(docs)
    assert kept.columns == docs.columns and kept.count() == quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").count()
    tested = {r["rule"]: r for r in quality_rules.ablations(quality_rules.ledger(docs)).collect()}
    assert tested["few_words"]["failed"] == int((got["n_words"] < 50).sum())
    assert all(r["kept_without"] >= r["kept"] for r in tested.values())
    assert quality_rules.ledger(docs.limit(0)).count() == 0


def test_simhash(spark, docs):
    got = simhash.groups(docs).toPandas()
    assert len(got) == len(rows())
    values = got["fp"].to_numpy().view(np.uint64)
    ids = got["doc_id"].fillna(-1).to_numpy()
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    reach = near.copy()
    for _ in range(5):
        reach = (reach.astype(int) @ near.astype(int)) > 0
    for i, c in enumerate(got["component_id"]):
        members = [x for x in ids[reach[i]] if x >= 0]
        assert (c == min(members)) if members else c != c
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    left = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 4 in left and 5 not in left and left.count(12) == 1 and 1 in left and 2 not in left
    assert simhash.groups(docs.limit(0)).count() == 0
    # fingerprints by their definition
    import xxhash

    for i, t in rows():
        if i is None or i == 10:
            continue
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[j : j + 4]) for j in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert set(got.loc[got["doc_id"] == i, "fp"].to_numpy().view(np.uint64)) == {want}, i


def test_keep_one_of_a_key(spark):
    """Different texts of one key are different documents; a null key never displaces another."""
    made = [(1, text(70, 60)), (1, text(71, 60)), (2, text(71, 60)), (None, text(70, 60)), (None, text(72, 60)), (None, text(72, 60)), (3, None), (4, "")]
    kept = simhash.keep_one(table(spark, made)).select("doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(1, text(70, 60)), (1, text(71, 60)), (0, text(72, 60)), (3, "")])


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    y = x.copy()
    for i in range(300):
        for b in rng.choice(63, rng.integers(0, 5), replace=False):
            y[i] ^= np.int64(1) << np.int64(b)
    row, key = simhash.own_keys(x)
    own = {(r, k) for r, k in zip(row.tolist(), key.tolist(), strict=True)}
    row, key = simhash.near_keys(y)
    near = {(r, k) for r, k in zip(row.tolist(), key.tolist(), strict=True)}
    assert {r for r, _ in own & near} == set(range(300))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    assert components.components(links.limit(0), "a", "b").count() == 0


def brute_repeats(documents):
    seen, out = set(), {}
    for i, t in documents:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 99):
            w = b[j : j + 100]
            if w in seen:
                gone[j : j + 100] = True
            seen.add(w)
        out[i] = bytes(np.frombuffer(b, np.uint8)[~gone])
    return out


def test_suffix_dedup(spark, docs, monkeypatch):
    rng = np.random.default_rng(8)
    # 45 bytes with a hundred neighbourhoods, some of which share more of it
    crowd = [(100 + i, text(500 + i % 70, 12) + " the forty five bytes that everybody quotes here " + text(600 + i % 23, 12 + i % 5)) for i in range(100)]
    runs = [(300 + i, "ab" * int(rng.integers(40, 90)) + text(700 + i, 5)) for i in range(10)]
    unique = sorted([r for r in dict(rows()).items() if r[0] is not None and r[0] != 10] + crowd + runs)
    some = table(spark, unique).repartition(3)
    want = brute_repeats(unique)
    # as it is; every anchor split to the end; many buckets, hot anchors dealt by segment
    for names in ({}, {"MOST_SEGMENTS": 1}, {"BUCKET_BYTES": 1500, "MOST_SEGMENTS": 20, "CHUNK_BYTES": 3000, "PIECE_BYTES": 1000, "BATCH_BYTES": 2000}):
        with monkeypatch.context() as m:
            for name, value in names.items():
                m.setattr(suffix_dedup, name, value)
            if "BUCKET_BYTES" in names:
                texts = suffix_dedup._keyed(some, "doc_id", "text").withColumn("base", F.lit(0).cast("long")).withColumn("within", F.lit(0).cast("long"))
                assert len(suffix_dedup._hot(texts, 40, 20_000))
            got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(some).collect()}
        assert got == want
    again = suffix_dedup.remove_repeats(docs).toPandas()
    assert len(again) == len(rows())
    assert suffix_dedup.without_repeats(docs).columns == docs.columns
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_merge_agrees_with_sorting():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, 40, dtype=np.uint8)) for _ in range(12)]
    got = suffix_dedup.repeats(strings, np.arange(12), length=6, shards=3)
    seen = set()
    for s, hits in zip(strings, got, strict=True):
        want = []
        for j in range(len(s) - 5):
            if s[j : j + 6] in seen:
                want.append(j)
            seen.add(s[j : j + 6])
        assert hits.tolist() == want


def test_token_files(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write(docs, folder, shard_size=40_000).cache()
    got = token_files.read(spark, manifest).toPandas()
    assert len(got) == len(rows()) and manifest.count() > 1
    coder = tokens.encoder()
    want = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    before = 0
    ordered = got.sort_values("start")
    for (i, t), r in zip(want, ordered.itertuples(), strict=True):
        ids = coder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id != r.doc_id or r.doc_id is None) if i is None else r.doc_id == i
        assert r.start == before and np.frombuffer(r.ids, "<u4").tolist() == ids
        before += len(ids)
    keys = spark.createDataFrame([(4,), (12,), (4,), (10**12,), (-5,)], "doc_id long")
    found = [r["doc_id"] for r in token_files.lookup(keys, manifest).collect()]
    assert sorted(found) == [4, 12, 12]
    empty = token_files.encode_to_files(docs.limit(0))
    assert empty.count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 5000)
    keys = np.unique(keys)
    h = token_files.PerfectHash.build(keys)
    assert sorted(h.slot(keys)) == list(range(len(keys)))


def test_packing(spark, docs):
    got = packing.pack(docs, group=16).toPandas()
    coder = tokens.encoder()
    lengths = got.groupby("sequence_id")["length"].sum()
    assert lengths.max() <= 2048
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    by = {i: t for i, t in rows() if i != 12}
    for i, part in got.groupby("doc_id"):
        if i == 12:
            continue
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in part.sort_values("start")["ids"]])
        assert ids.tolist() == coder.tokenizer.encode(by[i] or "", add_special_tokens=False).ids + [1]
    assert packing.pack(docs.limit(0)).count() == 0


def test_differencing():
    sizes = np.random.default_rng(0).integers(1, 200, 500)
    part = packing.differencing(sizes, 20)
    sums = np.bincount(part, weights=sizes, minlength=20)
    assert np.ptp(sums) < 40
    assert np.bincount(packing.windows(sizes, 2048), weights=sizes).max() <= 2048


def test_encoder_equals_library():
    coder = tokens.encoder()
    for t in ["It's 2 o'clock, ISN'T it?", "naïve ŒUVRE ½ ² İstanbul", "漢字 and ﬁne é", "a<|endoftext|>b", "x\x1cy\x00z\x85w v", "'S 'LL we'Re"]:
        assert coder.encode([t])[0].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids + [1], t


def plain_viterbi(c, text):
    """Best pieces of a whole normalised text by all pairs of positions; of equal sums the longer last piece."""
    sums, back = [0], [0]
    for j in range(1, len(text) + 1):
        found = []
        for i in range(max(0, j - c.longest), j):
            w = c.weight.get(text[i:j])
            if w is None and j == i + 1:
                w = c.unknown
            if w is not None:
                found.append((sums[i] + w, -i))
        sums.append(max(found)[0])
        back.append(-max(found)[1])
    at, parts = len(text), []
    while at:
        parts.append(text[back[at] : at])
        at = back[at]
    ids = []
    for p in reversed(parts):
        ids += [c.id[p]] if p in c.id else [c.bytes[x] for x in p.encode()]
    return ids


def test_sentencepiece(spark, docs):
    c = sentencepiece_scan.coder()
    by = {i: t for i, t in rows()}
    want = {i: plain_viterbi(c, sentencepiece_scan.normalised(t)) for i, t in by.items()}
    for size in (1 << 16, 1 << 10):
        got = sentencepiece_scan.decode(sentencepiece_scan.encode(docs, chunk=size, block=4)).collect()
        assert len(got) == len(rows())
        for r in got:
            assert r["decoded"] == (by[r["doc_id"]] or "")
            assert list(r["ids"]) == want[r["doc_id"]]
    assert sentencepiece_scan.encode(docs.limit(0)).count() == 0


def test_sentencepiece_agrees_with_the_library():
    """The library's own search over the same pieces and scores, once the model is read as a unigram one."""
    import public_tokenizers
    import sentencepiece

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(open(public_tokenizers.path(sentencepiece_scan.MODEL), "rb").read())
    model.trainer_spec.model_type = 1
    least = min(p.score for p in model.pieces if p.score > -1e8)
    for p in model.pieces:
        if p.score < -1e8:  # in the library's 32-bit sums these leave no digits
            p.score = least - 9
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rng = np.random.default_rng(9)
    syllables = "th in er an re on at en nd ti es or te of ed is it al ar st Ünï qu xx 7 42 . , --".split()
    lines = [" ".join("".join(rng.choice(syllables, rng.integers(1, 6))) for _ in range(40)) for _ in range(50)]
    got = sentencepiece_scan.coder().encode(lines)
    assert [g.tolist() for g in got] == [library.encode(x) for x in lines]


def test_sentencepiece_ties(spark):
    """Chunks of any size give the ids of the whole text, runs of spaces, unknown and rare characters included."""
    rng = np.random.default_rng(5)
    c = sentencepiece_scan.coder()
    letters = list("aaabbeest  \n.▁漢ü§")
    made = [(i, "".join(rng.choice(letters, int(n)))) for i, n in enumerate(rng.integers(16, 400, 40))] + [(40, " " * 100), (41, "e" * 333)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    for size, block in ((16, 2), (17, 3), (50, 256)):
        got = {r["doc_id"]: list(r["ids"]) for r in sentencepiece_scan.encode(df, chunk=size, block=block).collect()}
        assert got == {i: plain_viterbi(c, sentencepiece_scan.normalised(t)) for i, t in made}


def test_language_model(spark, docs):
    import math
    from collections import Counter

    got = language_model.score(docs).toPandas()
    assert len(got) == len(rows())
    counts = Counter()
    for i, t in rows():
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            counts.update([*language_model.words(t), b" end"])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*language_model.words(t), b" end"])
        mine = got[got["doc_id"].isna() if i is None else got["doc_id"] == i]
        assert np.allclose(mine["base_score"].astype(float), base)
        assert (mine["score"] < 0).all()
    assert language_model.score(docs.limit(0)).count() == 0


def test_language_model_chain(spark):
    """Each sweep starts from the tables of the one before; a context's probabilities sum to 1 after every sweep."""
    from pyspark.sql import functions as F

    made = spark.createDataFrame([(i, text(i, 300)) for i in range(40)], "doc_id long, text string").withColumn("held_out", F.lit(False))
    every = spark.createDataFrame([(99, " ".join(f"{a} {b}" for a in WORDS for b in WORDS))], "doc_id long, text string").withColumn("held_out", F.lit(True))
    both = made.union(every)
    common = language_model._common(both)
    seen = []
    for first, swept, state in language_model._chain(both, common, 3, 1):
        met = language_model._met(first, swept, common).toPandas()
        parts = [language_model._seating(r, common, state) for r in met.itertuples(index=False)]
        seen.append(np.concatenate([b.tables for b in parts]))
        assert state.customers == seen[-1].sum() and len(parts) == 1
        b = parts[0]
        tables = np.bincount(b.context, b.tables, len(b.contexts))
        assert (tables == b.context_tables).all()
        # words never seen behind a context, and the unseen word, have the parent's share
        s = state
        back = (language_model.STRENGTH + s.root_discount * s.root_tables) * b.base
        parent = (b.customers - s.root_discount * b.root + back) / (language_model.STRENGTH + s.customers)
        assert parent.sum() + back / (language_model.STRENGTH + s.customers) == pytest.approx(1)
        known, listed = np.bincount(b.context, b.probability()), np.bincount(b.context, parent[b.word])
        new = (language_model.STRENGTH + s.discount * b.context_tables) / (language_model.STRENGTH + b.context_tokens)
        assert known + (1 - listed) * new == pytest.approx(np.ones(len(known)))
    assert all((x != y).any() for x, y in zip(seen, seen[1:], strict=False))
    b.sweep(7)
    again = language_model._Seating(b.number, b.fixed, (np.minimum(b.count, 1), np.ones(len(b.hot)), np.zeros(len(b.count))), [(b.context_tables, b.context_tokens)], common, state)
    again.sweep(7)
    assert (b.tables != again.tables).any()  # the start matters


def test_language_model_rare_contexts(spark, monkeypatch):
    """A rare context has a restaurant at every size, and buckets agree on totals of contexts."""
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", 4000)
    made = [(i, text(i, 300)) for i in range(60)] + [(1000 + i, f"rare{i % 3} follower{i % 3} " * 2) for i in range(60)]
    rows = language_model._rows(spark.createDataFrame(made, "doc_id long, text string"), "doc_id", "text")
    common = language_model._common(rows)
    assert common.buckets > 1
    for first, swept, state in language_model._chain(rows, common, 1, 1):
        pass
    met = language_model._met(first, swept, common).toPandas()
    parts = [language_model._seating(r, common, state) for r in met.itertuples(index=False)]
    want, tokens = {}, {}
    for b in parts:
        for c, t, n in zip(b.contexts[b.context], b.tables, b.count, strict=True):
            want[c], tokens[c] = want.get(c, 0) + t, tokens.get(c, 0) + n
    for b in parts:
        assert [want[c] for c in b.contexts] == list(b.context_tables) and [tokens[c] for c in b.contexts] == list(b.context_tokens)
    rare = language_model._hash(b"rare0")
    assert tokens[rare] > 0 and {w for b in parts for w in b.contexts} >= {rare, language_model._hash(language_model.BEGIN)}
    assert len(language_model.score(spark.createDataFrame(made, "doc_id long, text string")).toPandas()) == len(made)


def test_language_model_context_bar(spark):
    """Above a million tokens, a context seen once still predicts what stood behind it."""
    made = [(10 + i, "a b " * 25000) for i in range(48)] + [(i, "y z " * 50) for i in (100, 101)] + [(102, "x y")]
    docs = spark.createDataFrame([(i, t) for i, t in made if zlib.crc32(str(i).encode()) % 7 != 2 or i == 102], "doc_id long, text string")
    train, *twice = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    held = [i for i in range(2000, 3000) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = docs.where("doc_id <> 102").union(spark.createDataFrame([(train, "x y"), (held[0], "x y"), (held[1], "x z"), *((i, " ".join(f"w{n}" for n in range(500))) for i in twice)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in language_model.score(docs).collect()}
    assert got[train]["train_tokens"] > 1_500_000
    assert got[held[0]]["score"] > got[held[1]]["score"] + 1


def test_seating():
    rng = np.random.default_rng(0)
    n = np.full(20000, 10)
    t = language_model.seat(n, np.full(20000, 1.0), 0.0, rng)
    assert t.mean() == pytest.approx(sum(1 / (1 + i) for i in range(10)), rel=0.02)  # strength 1, no discount
    assert (language_model.seat(np.array([0, 1, 100000]), np.full(3, 0.5), 0.5, rng) <= [0, 1, 100000]).all()


def test_quality_model(spark):
    rng = np.random.default_rng(0)
    made = [(i, text(i, 120) if i % 2 else " ".join(rng.choice(["BUY!!", "NOW!!", "$$$"], 120))) for i in range(200)]
    docs = table(spark, [*made, (900, None), (901, ""), (None, "x")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, labels).toPandas()
    assert len(got) == 203 and got["score"].between(0, 1).all()
    held = got[got["held_out"] & (got["doc_id"] < 200)]
    assert (held["predicted"] == held["doc_id"] % 2).mean() > 0.95
    assert quality_model.keep_good(docs, labels).columns == docs.columns
    assert quality_model.classify(docs, labels.limit(0)).where("score = 1").count() >= 0
    assert quality_model.classify(docs.limit(0), labels).count() == 0


def test_language_id(spark):
    made = [(i, text(i, 60) if i % 2 else text(i, 60)[::-1]) for i in range(120)]
    base = spark.createDataFrame([(i, t, "aa" if i % 2 else "bb") for i, t in made] + [(500, None, "aa"), (501, "12 34 !", "bb"), (502, "alpha beta", None)], "doc_id long, text string, lang string")
    got = language_id.identify(base).toPandas().set_index("doc_id")
    assert got.loc[500, "lang_pred"] == "und" and got.loc[501, "lang_pred"] == "und" and got.loc[500, "score"] == 0
    held = got[got["held_out"] & (got.index < 120)]
    assert all(r.lang_pred == ("aa" if i % 2 else "bb") for i, r in held.iterrows())
    assert got["score"].between(0, 1).all()
    assert set(language_id.identify(base.limit(0)).collect()) == set()


def brute_embeddings(data):
    """Links and classes of (id, vector, label) rows by all pairs."""
    sound = [(i, np.array(v, float), l) for i, v, l in data if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    sound = [(i, v / np.abs(v).max(), l) for i, v, l in sound]
    links = {i: set() for i, *_ in data}
    for n, (i, v, l) in enumerate(sound):
        for j, w, m in sound[n + 1 :]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    least = {}
    for i in sorted(links):
        todo, seen = [i], {i}
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least[i] = min(seen)
    return {i: (len(links[i]), least[i]) for i in links}


def test_packing_windows(spark):
    """Over several tasks: each id in one piece, windows gapless from 0 and within capacity, and nearly all of it used."""
    import math

    made = [(i, text(i, 20 + i * 7 % 900)) for i in range(300)] + [(1000, text(5, 9000)), (1001, None), (1002, "")]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = packing.pack(df).toPandas()
    coder = tokens.encoder()
    for (i, t), ids in zip(made, coder.encode([t for _, t in made]), strict=True):
        own = got[got["doc_id"] == i].sort_values("start")
        assert np.concatenate([np.frombuffer(x, "<u4") for x in own["ids"]]).tolist() == ids.tolist()
        assert own["start"].tolist() == [0, *np.cumsum(own["length"]).tolist()[:-1]] and (own["doc_tokens"] == len(ids)).all()
    for _, w in got.groupby("sequence_id"):
        w = w.sort_values("offset")
        assert w["offset"].tolist() == [0, *np.cumsum(w["length"]).tolist()[:-1]]
        assert w["length"].sum() <= packing.CAPACITY and (w["sequence_length"] == w["length"].sum()).all()
    full, windows = got["length"].sum(), got["sequence_id"].nunique()
    # at most one window that is not full per task, but for the imbalance of near-equal ones
    assert windows <= math.ceil(full / packing.CAPACITY) + 2 * 3


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 16))
    v[100:200] = v[:100] + rng.normal(size=(100, 16)) * 0.05
    v[200:210] = v[0]
    data = [(i, [float(x) for x in v[i]], int(i % 3)) for i in range(400)]
    data += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 16, None), (905, [None] * 16, 1), (906, [float("inf")] + [1.0] * 15, 1)]
    # another length, and components whose squares do not fit
    data += [(910, [1.0, 2.0, 3.0], 1), (911, [1.0, 2.0, 3.0], 1), (912, [1.0, 2.0, 3.1], 1), (913, [1e200, 2e200], 2), (914, [1.5e200, 3e200], 2), (915, [1e-200, -1e-200], 2)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in data], "vec_id long, embedding array<double>, label int, cell string, n int, block int")
    want = brute_embeddings(data)
    every = None
    for names in ({}, {"MAX_BEAM": 0, "MIN_RECALL": 2.0}, {"CENTROID_SAMPLE": 1, "AUDIT_ROWS": 1}):
        with monkeypatch.context() as m:
            for name, value in names.items():
                m.setattr(embedding_dedup, name, value)
            # the second finds no recall good enough and compares all; the third draws empty samples
            got = embedding_dedup.near_duplicates(df, min_recall=names.get("MIN_RECALL", 0.98)).toPandas()
        assert len(got) == len(data) and got["recall"].between(0, 1).all()
        rows = {r.vec_id: (r.n_links, r.component_id) for r in got.itertuples()}
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.itertuples())
        if "MAX_BEAM" in names:
            assert rows == want
        assert sum(rows[i] == want[i] for i in want) >= 0.98 * len(want) and all(rows[i][0] <= want[i][0] for i in want)
        assert {i: rows[i] for i in range(900, 916) if i in rows} == {i: want[i] for i in range(900, 916) if i in want}
        every = rows
    assert every is not None
    again = embedding_dedup.near_duplicates(df.where("vec_id in (1, 4)").union(df.where("vec_id in (1, 4)"))).toPandas()
    assert len(again) == 4 and (again["n_links"] == 1).all()
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_samples_of_any_share(spark):
    """Shares far below a millionth draw what they should; whole tables are whole."""
    from kmerloom.llm.common import sampled

    df = spark.range(200_000)
    assert df.where(sampled(1.0, "id")).count() == df.where(sampled(2, "id")).count() == 200_000
    assert 1700 < df.where(sampled(0.01, "id")).count() < 2300
    least = df.select((F.xxhash64("id", F.lit(0)).bitwiseAND(F.lit(2**63 - 1)) / F.lit(2.0**63)).alias("x")).agg(F.min("x")).first()[0]
    assert 0 < least < 1e-4 and df.where(sampled(least * 1.001, "id")).count() == 1


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables go through every stage."""
    import corpus_pipeline

    odd = table(spark, [r for r in rows() if r[0] != 10]).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 13)] + [(None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs_ in (odd, odd.limit(0)):
            out = stage(spark, docs_, str(tmp_path))
            assert name == "packing" or out.columns == odd.columns
            n = out.count()
            assert n <= odd.count() or name == "packing"
            assert not n or docs_ is odd
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats(spark, odd, str(tmp_path)).collect()}
    assert texts[1] is None and texts[2] == "" and texts[4] == text(4, 80) and texts[5] == ""
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, odd, str(tmp_path)).collect()}
    assert (4, text(4, 80)) in left and 5 not in {i for i, _ in left}
    passing = {r["doc_id"] for r in corpus_pipeline.rules(spark, odd, str(tmp_path)).collect()}
    assert not passing & {1, 2, 3, 11, 12}


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    made = [(i, text(i, 150), "en", "s", 0) for i in range(60)] + [(100, text(1, 150) + " tail", "en", "s", 0), (101, "!!! " * 80, "en", "s", 0)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(101, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert 100 not in set(out["doc_id"]) and 1 in set(out["doc_id"])


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_rows(spark):
    """Languages and qualities of rows that taught nothing, and the perplexity of held-out texts."""
    from kmerloom.llm import queries

    docs_ = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    lang = queries.op9_language_id(spark, DATA).where("held_out and lang_pred <> 'und'").join(docs_.where("lang is not null"), "doc_id")
    right, n = lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.97
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    good = queries.op5_quality_classifier(spark, DATA).where("held_out").join(labels, "doc_id")
    right, n = good.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 30 and right > 0.9
    scores = queries.op3_language_model(spark, DATA)
    model = {r["held_out"]: r["perplexity"] for r in language_model.perplexity(scores).collect()}
    base = {r["held_out"]: r["perplexity"] for r in language_model.perplexity(scores, "base_score").collect()}
    assert model[True] < 0.5 * base[True] and model[False] < model[True]
