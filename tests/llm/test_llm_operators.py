"""Operators on small tables: brute force, round trips, and the defined cases (nulls, empties, ties, repeats, clashing names)."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import ann_bits, bpe_prefix, components, jaccard_join, line_dedup, media, packing, token_spans, toxicity, url_trees, warc_index
from tallyframe.llm.storage import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long, raw string, key long, h long, class int"


def documents(spark, texts):
    """Rows with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 3) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", "plain words here", "plain words here", "é ü　x", "a" * 5000, "word " * 3000, "<|endoftext|> x", "\n\n\nx\n", " \t\x0b"]


def test_media_round_trip(spark):
    docs = documents(spark, ODD)
    got = {r["doc_id"]: r for r in media.media_features(media.store_as_media(docs)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert got[i]["media_type"] == "audio/wav" and got[i]["media_bytes"] == len(payload) + 44
    assert got[2]["feature"] == got[3]["feature"] and got[0]["media_sha256"] == got[1]["media_sha256"]
    assert media.media_features(media.store_as_media(docs.limit(0))).count() == 0


def test_sniffing_carves_and_corrects(spark):
    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02\x02\x44\x01\x00" + b"\x3b"
    gz = zlib.compressobj(wbits=31)
    packed = gz.compress(b"hello" * 50) + gz.flush()
    blob = b"junk BM %PDF- " + png + b"--" + gif + packed + png[:-2]
    assert [(k, blob[a : a + n]) for a, n, k in media.find_media(blob)] == [("image/png", png), ("image/gif", gif), ("application/gzip", packed)]
    rows = spark.createDataFrame([(0, png, "image/jpeg"), (1, None, "x"), (2, b"text", "text/plain")], "doc_id long, media binary, declared_type string")
    got = {r["doc_id"]: (r["media_type"], r["corrected"]) for r in media.sniff_media(rows).collect()}
    assert got == {0: ("image/png", True), 1: (None, False), 2: ("text/plain", False)}
    assert media.find_media(png[:-1]) == []


def test_token_counts_add_up(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = documents(spark, ODD + ["one line\n\n two  lines\nend"])
    for rule in token_spans.RULES:
        rows = token_spans.attribute_tokens(docs, rule=rule).collect()
        for i, t in enumerate([*ODD, "one line\n\n two  lines\nend"]):
            own = sorted((r["section"], r["start_char"], r["end_char"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
            assert sum(x[3] for x in own) == pytest.approx(len(tokenizer.encode(t or "", add_special_tokens=False).ids))
            assert [x[1] for x in own[1:]] == [x[2] for x in own[:-1]] and own[0][1] == 0 and own[-1][2] == len(t or "")


def test_allocation_rules():
    ends, bounds = np.array([3, 9, 10]), np.array([0, 4, 4, 10])
    assert token_spans.allocate(ends, bounds, "start").tolist() == [2, 0, 1]
    assert token_spans.allocate(ends, bounds, "majority").tolist() == [1, 0, 2]
    assert token_spans.allocate(ends, bounds, "split").tolist() == pytest.approx([1 + 1 / 6, 0, 5 / 6 + 1])


def test_fields_as_sections(spark):
    rows = token_spans.attribute_tokens(documents(spark, ["x y"]), field_cols=("source", "text"), section_break=None).orderBy("section").collect()
    assert [(r["field"], r["start_char"], r["end_char"]) for r in rows] == [("source", 0, 2), ("text", 2, 5)]


def test_prefix_bpe_equals_the_library(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    bpe, rand = bpe_prefix.PrefixBpe(P.path("byte_bpe_50k.json")), random.Random(5)
    letters = "etaoin shrdlu'stTHE ...012\t\n é中😀\x1c\x85　"
    texts = ["".join(rand.choice(letters) for _ in range(rand.randint(0, 60))) for _ in range(1500)]
    for t in [*texts, *[t for t in ODD if t is not None], "ab" * 2000, "x<|endoftext|><|endoftext|>y"]:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t) == ids
        assert bpe.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)
    docs = documents(spark, ODD)
    back = bpe_prefix.decode_documents(bpe_prefix.encode_documents(docs))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}
    got = {r["doc_id"]: r for r in bpe_prefix.digest_round_trip(docs).collect()}
    ids = tokenizer.encode(ODD[6], add_special_tokens=False).ids
    assert got[6]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[0]["n_tokens"] == 0


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10), (1, 1, 2)])
def test_jaccard_classes_equal_brute_force(spark, n, num, den):
    rand = random.Random(n)
    words = [f"w{i}" for i in range(400)]
    texts = [*ODD, "A b C", "a B c", "one two", "one  two"]
    for size in (4, 12, 30, 70, 150, 400):
        for _ in range(6):
            base = [rand.choice(words) for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, size // 40, size // 20, size // 12):
                copy = list(base)
                for _ in range(edits):
                    copy[rand.randrange(size)] = rand.choice(words)
                texts.append(" ".join(copy))

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    got = jaccard_join.jaccard_classes(documents(spark, texts), n=n, num=num, den=den).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_long_lists_of_loose_copies(spark):
    """Many copies of one text, each a little different: lists are long, and not all pairs link."""
    rand = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(60):
        copy = list(base)
        for _ in range(k % 12):
            copy[rand.randrange(120)] = f"c{rand.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [set(zip(*[t.split()[i:] for i in range(3)], strict=False)) for t in texts]
    label = list(range(60))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(60):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    got = jaccard_join.jaccard_classes(documents(spark, texts), n=3, num=90, den=100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: root(i) for i in range(60)}


@pytest.mark.parametrize("n,num,den,tight", [(3, 90, 100, 4), (3, 90, 100, 0), (1, 1, 2, 0)])
def test_link_counts_equal_brute_force(spark, monkeypatch, n, num, den, tight):
    """Groups of loose copies with exact ones among them, in several blocks: each link is counted once at each end."""
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(jaccard_join, "TIGHT", tight)
    rand, texts = random.Random(7), [None, "", "a b", "A  b"]
    for size in (8, 30, 120):
        base = [f"b{size}x{i}" for i in range(size)]
        for k in range(60):
            copy = list(base)
            for _ in range(k % (1 + size // 8)):
                copy[rand.randrange(size)] = f"c{rand.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [set(zip(*[w[i:] for i in range(min(n, len(w)))], strict=False)) for w in [(t or "").lower().split() for t in texts]]
    linked = lambda a, b: bool(a & b) and den * len(a & b) >= num * len(a | b)
    want = {i: sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    got = jaccard_join.jaccard_links(documents(spark, texts), n=n, num=num, den=den).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and max(want.values()) > 20


@pytest.mark.parametrize("tight", [4, 0])
def test_link_counts_along_a_chain(spark, monkeypatch, tight):
    """Sliding windows of 40 words: lists overlap in one long chain, where a pair shares several long lists."""
    monkeypatch.setattr(jaccard_join, "TIGHT", tight)
    texts = [" ".join(f"w{j}" for j in range(k, k + 40)) for k in range(600)]
    got = jaccard_join.jaccard_links(documents(spark, [*texts, texts[5]]), n=3, num=1, den=2).collect()
    reach = max(s for s in range(38) if 2 * (38 - s) >= 38 + s)
    want = {k: sum(abs(k - j) <= reach for j in range(600)) - 1 + (abs(k - 5) <= reach) for k in range(600)}
    assert {r["doc_id"]: r["n_links"] for r in got} == want | {600: want[5]}
    assert {r["component_id"] for r in got} == {0}


def test_no_link_counts(spark):
    assert jaccard_join.jaccard_links(documents(spark, ["a b c d", "e f g h"])).where("n_links <> 0").count() == 0
    assert jaccard_join.jaccard_links(documents(spark, ["a"]).limit(0)).count() == 0


def test_no_links_and_empty_tables(spark):
    assert jaccard_join.jaccard_classes(documents(spark, ["a b c d", "e f g h"])).where("component_id <> doc_id").count() == 0
    assert jaccard_join.jaccard_classes(documents(spark, ["a"]).limit(0)).count() == 0
    kept = jaccard_join.keep_one_of_each(documents(spark, ["a b c d e f", "a b c d e f", None, None]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3] and kept.columns == documents(spark, []).columns


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (20, 9), (7, 7)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in (1, 2, 3, 4, 5)}) == 1 and got[8] == got[9] == got[20] != got[1] and 7 not in got


def toxic_fixture(n=400):
    rand = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(n):
        t = [rand.choice(words) for _ in range(rand.randint(5, 60))]
        bad = i % 5 == 1
        if bad:
            t.insert(rand.randrange(len(t)), rand.choice(["vilest", "cursed", "hatewordy"]))
        texts.append(" ".join(t))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_on_unseen_texts(spark):
    texts, labels = toxic_fixture()
    docs = documents(spark, [*texts, None, ""])
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if i < 300] + [(99999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y in enumerate(labels) if i >= 300]
    assert sum(right) / len(right) > 0.95
    assert got[400] == got[401] < 0.5 and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id >= 400").count() == 2


def test_toxicity_without_positives(spark):
    docs = documents(spark, ["a b", "c"])
    model = toxicity.train(docs, spark.createDataFrame([(0, 0)], "doc_id long, toxic int"))
    assert {round(r["score"], 3) for r in toxicity.score_documents(docs, model).collect()} == {round((0 + 1) / (1 + 2), 3)}


def test_toxicity_defined_cases(spark):
    texts, labels = toxic_fixture(100)
    docs = documents(spark, texts)
    known = spark.createDataFrame(list(enumerate(labels)) * 2, "doc_id long, toxic int")
    model = toxicity.train(docs.unionByName(docs.where("doc_id = 1")).withColumn("gram", F.lit("x")), known)
    assert model.score("a vilest cursed hatewordy text") > model.score("a text") and model.score(None) == model.score("")
    empty = toxicity.train(docs.limit(0), known)
    assert toxicity.score_documents(docs.limit(0), empty).count() == 0 and toxicity.train(docs, known.limit(0)).score("x") == 0.5


def test_gram_counts_equal_brute_force(spark):
    texts = [*toxic_fixture(40)[0], None, "", "x " * 5000, "abcdefgh abcdefgx abcdefgy abcdefgz abcdefgw"]
    docs = documents(spark, texts).repartition(3)
    want = {}
    for t in texts:
        held = {}
        for run in set((t or "").lower().split()):
            for g in toxicity.grams(run):
                held[g] = held.get(g, 0) + 1
        for g, n in held.items():
            row = want.setdefault(g, [0] * len(toxicity.LEVELS))
            for k, level in enumerate(toxicity.LEVELS):
                row[k] += n >= level
    got = {r["gram"]: list(r)[1:] for r in toxicity.count_grams(docs).collect()}
    assert got == want and got["abcd"][-1] == 1
    names = sorted(want)[::3]
    assert toxicity.count_known(docs, names).tolist() == [want[g] for g in names]


def test_nnpu_gradient_is_that_of_the_risk():
    """Finite differences of both parts, above and below zero."""
    rand = np.random.default_rng(5)
    p = toxicity._distinct((rand.random((40, 5)) < 0.9).astype(np.uint8))
    u = toxicity._distinct((rand.random((90, 5)) < 0.1).astype(np.uint8))
    below = 0
    for _ in range(20):
        w = rand.standard_normal(6) * 3
        wrong, clean, g_wrong, g_clean = toxicity.nnpu_risk(w, p, u, 0.4)
        below += clean < 0
        for i in range(6):
            step = np.eye(6)[i] * 1e-5
            up, down = toxicity.nnpu_risk(w + step, p, u, 0.4), toxicity.nnpu_risk(w - step, p, u, 0.4)
            assert (up[0] - down[0]) / 2e-5 == pytest.approx(g_wrong[i], abs=1e-6) and (up[1] - down[1]) / 2e-5 == pytest.approx(g_clean[i], abs=1e-6)
    assert 0 < below < 20


def test_nnpu_separates():
    rand = np.random.default_rng(1)
    p = (rand.random((200, 6)) < [0.9, 0.5, 0.5, 0.5, 0.5, 0.5]).astype(np.uint8)
    u = (rand.random((1000, 6)) < [0.09, 0.5, 0.5, 0.5, 0.5, 0.5]).astype(np.uint8)
    w, b = toxicity.nnpu_fit(p, u, 0.1)
    assert w[0] > 2 and w[0] + b > 0 > b


def test_nearest_neighbours_equal_brute_force(spark):
    rand = np.random.default_rng(2)
    v = rand.standard_normal((700, 48)) * rand.uniform(0.5, 2, (700, 1))
    v[100:160] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [0.0] * 48), (702, [1.0] * 47 + [float("nan")]), (703, [1.0]), (704, [None] * 48), (None, [1.0] * 48)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann_bits.search(table, table.where("vec_id % 20 = 0"), k=20).collect()
    hits = total = 0
    for q in range(0, 700, 20):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        score = (v * v[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(700), -score)) if i != q][:20]
        hits += len(set(want) & {r["vec_id"] for r in own})
        total += 20
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(r["score"] == score[r["vec_id"]] for r in own)
    assert hits / total >= 0.99
    few = ann_bits.search(table.where("vec_id < 5"), table.where("vec_id = 0"), k=20)
    assert few.count() == 4
    blocks = ann_bits.search(table, table.where("vec_id % 20 = 0"), k=20, block_rows=10, part_rows=150)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, found))
    assert ann_bits.search(table.limit(0), table.limit(0)).count() == 0


def test_estimates_lie_within_their_bounds():
    rand = np.random.default_rng(4)
    v, turn = rand.standard_normal((2000, 64)), ann_bits.rotation(64)
    codes = ann_bits.BitCodes.build(v, turn)
    inside = []
    for q in rand.standard_normal((20, 64)):
        estimate, slack = codes.bounds(q, turn)
        inside.append(np.abs(estimate - v @ q) <= slack)
    assert np.mean(inside) > 0.995


def dedup_by_hand(texts, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    lines = [(t or "").split("\n") for t in texts]
    count: dict = {}
    for ls in lines:
        for k in {key(x) for x in ls}:
            count[k] = count.get(k, 0) + 1
    out = []
    for ls in lines:
        kept = [x for x in ls if not (len(key(x)) >= 1 and count[key(x)] >= min_docs)]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("bucket_rows", [2048, 7])
def test_line_dedup_equals_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(line_dedup, "BUCKET_ROWS", bucket_rows)
    rand = random.Random(6)
    pool = ["Shared line", " shared LINE\t", "Ärger", "ärger", "", "  ", "x", *[f"own {i}" for i in range(200)]]
    texts = [None, "", *["\n".join(rand.choice(pool) for _ in range(rand.randint(1, 12))) for _ in range(120)]]
    docs = documents(spark, texts)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == dict(enumerate(dedup_by_hand(texts, 10)))
    whole = line_dedup.replace_texts(docs)
    assert whole.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in whole.collect()} == {i: None if texts[i] is None else k[2] for i, k in got.items()}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_counts_ids(spark):
    """Rows with equal ids are one document, rows without id none; both are cut like others."""
    rows = [(7, "hot\nown a")] * 10 + [(None, "free\nshared")] * 12 + [(i, "shared\nx") for i in range(20, 30)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 32
    assert {r["kept"] for r in got if r["doc_id"] == 7} == {"hot\nown a"}
    assert {r["kept"] for r in got if r["doc_id"] is None} == {"free"} and {r["kept"] for r in got if (r["doc_id"] or 0) >= 20} == {""}


def test_line_dedup_on_a_million_lines(spark):
    """All distinct lines are indexed, in several shards; only the shared ones go."""
    n = 1_000_000
    docs = spark.range(1000).selectExpr("id AS doc_id", f"concat_ws('\n', transform(sequence(0, {n // 1000 - 1}), i -> concat('line ', id * 1000 + i)), concat('pair ', id % 90)) AS text")
    total = line_dedup.dedup_lines(docs).agg(F.sum("n_lines"), F.sum("n_dropped"), F.min("n_dropped")).first()
    assert tuple(total) == (n + 1000, 1000, 1)


def test_perfect_hash():
    h = np.unique(np.random.default_rng(3).integers(0, 2**63, 20_000, np.int64)).view(np.uint64)
    counts = np.arange(len(h)) + 10
    built = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(h, counts).to_bytes())
    assert sorted(built.slots(h).tolist()) == list(range(len(h)))
    assert (built.count_of(h) == counts).all()
    assert (built.count_of(np.random.default_rng(4).integers(0, 2**63, 50_000, np.int64).view(np.uint64)) > 0).sum() <= 1


def test_packing_covers_every_token(spark):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rand = random.Random(8)
    texts = [*ODD, "<|startoftext|> Hi", "İstanbul ΣΑΣ J̌ x\x1cy", "don't!!! 's (a) b-c. d,", "a. b,c 5.5 .x ,y", "a.. b., c_. \"q.\" ². ª,", "end...", "ßİ, x", *[" ".join(rand.choice(["alpha", "Beta,", "gamma's", "5th", "δ"]) for _ in range(rand.randint(1, 900))) for _ in range(40)]]
    rows = packing.pack_documents(documents(spark, texts), window=256).collect()
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) and own[0]["start"] == 0
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) and r["doc_tokens"] == len(ids)
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= own[0]["padded"] <= 256
    assert packing.pack_documents(documents(spark, []).limit(0)).count() == 0


def test_packing_plan_uses_every_piece_once():
    histogram = np.random.default_rng(1).integers(0, 50, 64)
    used = np.zeros(65, int)
    for classes, n in packing.plan_patterns(histogram):
        assert sum(classes) <= 64 and n > 0
        for k in classes:
            used[k] += n
    assert (used[1:] == histogram).all()
    filled = sum(sum(c) * n for c, n in packing.plan_patterns(histogram)) / (64 * sum(n for _, n in packing.plan_patterns(histogram)))
    assert filled > 0.95


def test_url_rules_and_trees(spark):
    cases = [
        ("https://WWW.Example.COM/en/1?x", ("www.example.com", "/en/1", "www.example.com/en/", "allow")),
        ("http://blog.example.com/en/1#t", ("blog.example.com", "/en/1", "example.com/en/", "block")),
        ("http://example.com/fr", ("example.com", "/fr", "com/", "allow")),
        ("http://x.net/es/", ("x.net", "/es/", "net/es/", "block")),
        ("http://com", ("com", "", None, None)),
        ("http://notcom.org/en/", ("notcom.org", "/en/", None, None)),
        ("no scheme", ("", "", None, None)),
        (None, ("", "", None, None)),
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, (u, _) in enumerate(cases)], "page_id long, url string, host string")
    model = url_trees.train(url_trees.labelled_by_rules(pages))
    for r in url_trees.judge_urls(pages, model).collect():
        host, path, rule, verdict = cases[r["page_id"]][1]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    empty = url_trees.train(url_trees.labelled_by_rules(pages.limit(0)))
    assert url_trees.judge_urls(pages, empty).count() == len(cases)


def test_url_trees_learn_lexical_rules():
    rand = random.Random(2)
    urls = [f"http://h{rand.randrange(50)}.org/{'ads' if bad else 'news'}/{rand.randrange(10**6)}" + ("?a=1&b=2&c=3" if bad else "") for bad in [i % 3 == 0 for i in range(900)]]
    labels = [int(i % 3 == 0) for i in range(900)]
    model = url_trees.UrlModel(urls[:600], labels[:600])
    scores = model.score(urls[600:], [url_trees.split_url(u) for u in urls[600:]])
    assert np.mean((scores >= 0.5) == np.array(labels[600:])) > 0.98


def test_url_model_counts_all_labelled_urls(spark):
    """The sample that the trees are fitted on bounds neither the label shares nor the suffix statistics."""
    rows = [(f"http://h{i}.{'org' if i % 5 else 'net'}/p{i % 120}/x", int(i % 10 > 0)) for i in range(1000)]
    model = url_trees.train(spark.createDataFrame(rows, "url string, label int"), max_training_rows=100)
    want = url_trees.count_parts([u for u, _ in rows], [y for _, y in rows])
    assert [{k: v[:, 0].tolist() for k, v in t.items()} for t in model.stats] == [{k: v.sum(1).tolist() for k, v in t.items()} for t in want] and len(want[1]) == 120
    assert model.prior == (900 + 0.5) / (1000 + 1)
    scores = model.score(*zip(*[(u, url_trees.split_url(u)) for u, _ in rows], strict=True))
    assert abs(scores.mean() - 0.9) < 0.05


def test_url_that_many_rows_share(spark):
    """A frequent URL is one training row with its weight, taken or not by its hash like any other."""
    rows = [("http://a.com/x", 0)] * 3000 + [(f"http://b{i}.net/es/{i}", 1) for i in range(5)] + [(None, 0), ("http://c.com/", None)]
    model = url_trees.train(spark.createDataFrame(rows, "url string, label int"), max_training_rows=8)
    assert model.prior == (5 + 0.5) / (3006 + 1)
    judged = lambda u: model.score([u], [url_trees.split_url(u)])[0]
    assert judged("http://a.com/x") < 0.1 < 0.5 < judged("http://b7.net/es/9")


def test_rules_equal_brute_force(spark):
    """Rules over many URLs against regular expressions, and held-out accuracy of the trees on what the rules say."""
    rand = random.Random(21)
    hosts = ["example.com", "www.example.com", "a.www.example.com", "x.net", "net", "com", "y.org", "EXAMPLE.com", "notexample.com"]
    urls = [f"http{rand.choice(['', 's'])}://{rand.choice(hosts)}{rand.choice(['', '/', '/en/', '/en', '/es/a', '/fr/', '/EN/'])}{rand.choice(['', '?q=/es/', '#/en/', 'x/y'])}" for _ in range(800)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("allow", r"(.*\.)?com", "/", "com/"), ("block", r"(.*\.)?example\.com", "/en/", "example.com/en/"), ("allow", r"(.*\.)?www\.example\.com", "/en/", "www.example.com/en/"), ("block", r"(.*\.)?net", "/es/", "net/es/"), ("block", r"(.*\.)?net", "/fr/", "net/fr/")]
    model = url_trees.train(url_trees.labelled_by_rules(pages.where("page_id % 5 > 0")))
    right = []
    for r in url_trees.judge_urls(pages, model).collect():
        host, path = re.fullmatch(r"[^:]*://([^/?#]*)([^?#]*).*", urls[r["page_id"]]).groups()
        fits = [(name, verdict) for verdict, h, p, name in rules if re.fullmatch(h, host.lower()) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host.lower(), path, best[0])
        if best[0]:
            assert r["verdict"] == best[1]
            right += [(r["score"] >= 0.5) == (best[1] == "block")] if r["page_id"] % 5 == 0 else []
    assert len(right) > 50 and sum(right) / len(right) > 0.9


@pytest.mark.parametrize("most", [500_000, 0])
def test_equal_payloads_either_way(spark, most):
    rows = [(i, "u", "p" if i % 3 else f"own {i}") for i in range(60)] + [(None, "u", "p")]
    linked = warc_index.link_equal_payloads(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_digests=most)
    got = {r["page_id"]: r["refers_to"] for r in linked.collect()}
    assert got == {i: 59 if i % 3 and i != 59 else None for i in range(60)} | {None: None}


def test_warc_round_trip(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x\r\n\r\ny" * 2000, "<p>é</p>"]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n" if i else None, h, "z") for i, h in enumerate(html)] + [(None, "u", "lone", "z")], "page_id long, url string, html string, digest string")
    index = warc_index.write_archives(warc_index.link_equal_payloads(pages))
    got = {r["page_id"]: r for r in warc_index.read_records(index).collect()}
    last = {(h or ""): i for i, h in enumerate(html)}
    for i, h in enumerate(html):
        raw, r = (h or "").encode(), got[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == warc_index.payload_digest(raw)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
        assert bytes(r["payload"]) == (raw if r["record_type"] == "response" else b"")
    assert got[None]["record_type"] == "response"
    some = warc_index.read_records(index.where("page_id IN (2, 4)"))
    assert sorted(r["page_id"] for r in some.collect()) == [2, 4]
    big = warc_index.write_archives(warc_index.link_equal_payloads(pages, min_payload=100))
    assert warc_index.read_records(big).where("record_type = 'revisit'").count() == 0
    assert warc_index.read_records(warc_index.write_archives(warc_index.link_equal_payloads(pages.limit(0)))).count() == 0


def test_ranges_are_coalesced():
    spans = [(0, 10), (10, 5), (20, 5), (1000, 5), (1005, 5)]
    assert warc_index.coalesce_ranges(spans, max_gap=8, max_read=100) == [(0, 3), (3, 5)]
    assert warc_index.coalesce_ranges(spans, max_gap=8, max_read=16) == [(0, 2), (2, 3), (3, 5)]
    assert warc_index.coalesce_ranges([]) == []


def test_materialized_tables_stay(spark):
    assert materialize(spark.range(3), "x").count() == 3


def test_prefix_bpe_splits_every_code_point_like_the_library():
    """Letters, numbers and white space are those of the library, not of another Unicode version."""
    from tokenizers.pre_tokenizers import ByteLevel

    words = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    bpe = bpe_prefix.PrefixBpe(P.path("byte_bpe_50k.json"))
    for low in range(0, 0x110000, 512):
        text = "".join(f"{c}'s a{c}1{c}!{c} {c}" for c in map(chr, range(low, low + 512)) if not "\ud800" <= c <= "\udfff")
        got, at = [], 0
        for chunk in bpe.chunk.findall(text):
            for word in bpe.word.findall(chunk):
                got.append((at, at + len(word)))
                at += len(word)
        assert got == [span for _, span in words(text)], hex(low)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in ("֋'s", "՘'s", "౜'s", "\U0003fc3f's"):
        assert bpe.encode(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_long_runs_are_encoded(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rand = random.Random(4)
    encoding, _ = token_spans._encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    pieces = ["a b", " ", "  ", " " * 4095, " " * 4096, " " * 5000, " \n" * 3000, "\t" * 4096, "x", "　" * 4200, "!!", " 's "]
    for _ in range(60):
        t = "".join(rand.choice(pieces) for _ in range(8))
        assert token_spans.encode_whole(encoding, t) == tokenizer.encode(t, add_special_tokens=False).ids
    long = [" " * 5_000_000 + "x", "a" * 1_000_000, "\n" * 1_000_000 + "y"]
    rows = token_spans.attribute_tokens(documents(spark, long)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(long)}


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_token_counts_equal_brute_force(spark, rule):
    """Per section, by walking through the library's own offsets character by character."""
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rand = random.Random(12)
    texts = ["".join(rand.choice(["ab", " the", "\n", "\n\n", "x\n", "...", " 12", "  "]) for _ in range(60)) for _ in range(25)]
    rows = token_spans.attribute_tokens(documents(spark, texts), rule=rule).collect()
    for i, t in enumerate(texts):
        own = sorted((r["section"], r["start_char"], r["end_char"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
        section_of = [next(s for s, a, b, _ in own if a <= c < b) for c in range(len(t))]
        want = [0.0] * len(own)
        for a, b in tokenizer.encode(t, add_special_tokens=False).offsets:
            held = [section_of[c] for c in range(a, b)]
            if rule == "start":
                want[held[0]] += 1
            elif rule == "majority":
                want[min(set(held), key=lambda s: (-held.count(s), s))] += 1
            else:
                for s in held:
                    want[s] += 1 / len(held)
        assert [x[3] for x in own] == pytest.approx(want)


def test_padding_is_the_window_or_a_power_of_two(spark):
    texts = ["x " * n for n in (255, 63, 99, 700)]  # with the end id: 256, 64, 100, 701 tokens
    rows = packing.pack_documents(documents(spark, texts), window=256).collect()
    for s in {r["sequence_id"] for r in rows}:
        filled = sum(r["length"] for r in rows if r["sequence_id"] == s)
        assert {r["padded"] for r in rows if r["sequence_id"] == s} == {filled if filled & (filled - 1) == 0 else 256}


def test_links_through_rows_without_id(spark):
    """A text that only rows without id hold connects its neighbours."""
    words = [f"w{i}" for i in range(24)]
    bridge = [*words[:-2], "x1", "x2"]
    far = ["y1", "y2", *bridge[2:]]
    rows = [(9, " ".join(words)), (None, " ".join(bridge)), (1, " ".join(far)), (5, "alone here with six own words")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_classes(table).collect()}
    assert got == {9: 1, None: 1, 1: 1, 5: 5}
    assert {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_links(table).collect()} == {9: 1, None: 2, 1: 1, 5: 0}


def test_one_row_of_repeated_ids_stays(spark):
    t, other = "a b c d e f g", "h i j k l m n"
    rows = [(3, t), (3, t), (4, t), (5, other), (3, other), (3, other), (6, None), (6, None), (None, t), (7, "x")]
    kept = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, t), (3, t), (3, other), (6, ""), (6, ""), (7, "x")]


@pytest.mark.parametrize("hot", [2, 10**9])
def test_hot_lists_give_the_same_classes(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    rand = random.Random(19)
    base = [f"b{i}" for i in range(30)]
    texts = []
    for k in range(90):
        copy = list(base)
        for _ in range(k % 4):
            copy[rand.randrange(30)] = f"c{rand.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [set(zip(*[t.split()[i:] for i in range(3)], strict=False)) for t in texts]
    want = {i: sum(10 * len(a & b) >= 9 * len(a | b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)}
    got = jaccard_join.jaccard_links(documents(spark, texts).repartition(3), n=3, num=90, den=100).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want


def test_packing_letters_that_normalize_to_a_combining_mark():
    import unicodedata

    import public_tokenizers
    from tallyframe.llm import packing

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    odd = [c for c in letters if len(unicodedata.normalize("NFC", c)) > 1]
    assert len(odd) >= 59
    texts = [f"a {c}{m}" for c in odd for m in packing.MARKS] + [f"a {c}{m}" for c in letters[::7] for m in ".)"]
    want = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert encoder.encode(texts) == [np.array(w.ids, "<u4").tobytes() for w in want]
    long_run = "漢" * 5000
    assert encoder.encode([long_run]) and all(len(r) <= packing.LONG for r in encoder.known)


def test_toxicity_counts_in_passes_and_shortlists_ties(spark):
    from tallyframe.llm import toxicity

    texts = [("alpha beta alphabet " + " ".join(f"w{i}x{j}" for j in range(40)),) for i in range(3)] + [("alpha " * 3,), (None,), ("z" * 500,)]
    docs = spark.createDataFrame(texts, "text string")
    rows = lambda df: {r["gram"]: tuple(r)[1:] for r in df.collect()}
    assert rows(toxicity.count_grams(docs)) == rows(toxicity.count_grams(docs, most=50))
    tied = spark.createDataFrame([(f"g{i:04}", 6, 0, 0, 0) for i in range(500)], toxicity.GRAM_SCHEMA)
    names, in_p = toxicity.shortlist(tied, tied.limit(0), 6, 10, 20)
    assert len(names) == 20 and in_p[:, 0].tolist() == [6] * 20


def _slow_pdf(data, at):
    if not data[at + 5 : at + 8].replace(b".", b"", 1).isdigit():
        return None
    begin = data.find(b"startxref", at)
    end = data.find(b"%%EOF", begin) if begin >= 0 else -1
    return end + 5 - at if end >= 0 else None


def _slow_zip(data, at):
    import struct

    pos = data.find(b"PK\x05\x06", at)
    while pos >= 0 and pos + 22 <= len(data):
        size, start, comment = struct.unpack_from("<IIH", data, pos + 12)
        if start + size == pos - at and data[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
            return pos + 22 + comment - at if pos + 22 + comment <= len(data) else None
        pos = data.find(b"PK\x05\x06", pos + 4)
    return None


def test_media_scan_is_linear_and_equals_slow_validators():
    import io
    import time
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "x" * 50)
    whole = held.getvalue()
    ogg = b"OggS" + bytes([0, 0]) + bytes(20) + bytes([1, 3]) + b"abc"
    last = b"OggS" + bytes([0, 4]) + bytes(20) + bytes([1, 3]) + b"abc"
    dice = random.Random(4)
    pieces = [b"%PDF-1.4 ", b"startxref 1", b"%%EOF", b"%PDF-x", whole, whole[:30], whole[-22:], ogg, last, b"GIF89a", b"PK\x05\x06"]
    for _ in range(60):
        data = b"".join(dice.choice(pieces) for _ in range(12))
        found = set(media.find_media(data))
        for kind, magic, slow in (("application/pdf", b"%PDF-", _slow_pdf), ("application/zip", b"PK\x03\x04", _slow_zip)):
            want = {(m.start(), n, kind) for m in re.finditer(re.escape(magic), data) if (n := slow(data, m.start()))}
            assert {f for f in found if f[2] == kind} == want
        for m in re.finditer(b"OggS", data):
            pos, end = m.start(), None
            while data[pos : pos + 4] == b"OggS" and pos + 31 <= len(data):
                end, pos = data[pos + 5] & 4, pos + 31
                if end:
                    break
            assert ((m.start(), pos - m.start(), "audio/ogg") in found) == bool(end)
    for unit in (b"%PDF-1.4 ", b"PK\x03\x04 xxxx", b"GIF89a" + bytes(7) + b",", ogg, b"RIFF    WAVE", b"\xff\xd8\xff", b"BM", b"MThd", b"ftyp"):
        began = time.time()
        media.find_media(unit * (2_000_000 // len(unit)) + b"startxref %%EOF")
        assert time.time() - began < 30, unit


def test_neighbours_of_repeated_query_ids(spark):
    dice = np.random.default_rng(3)
    base = dice.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(20, base[20].tolist())] * 30 + [(40, base[3].tolist()), (20, [None] * 8), (20, [0.0] * 8), (21, base[21].tolist())] + [(i, base[7].tolist()) for i in range(100, 140)] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann_bits.search(table, table.where("vec_id % 20 = 0"), part_rows=40, block_rows=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    fine = [(i, np.array(v)) for i, v in rows if None not in v and any(v)]
    queries = {}
    for i, v in fine:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v.tolist()), v.tolist())
    assert set(got) == set(queries)
    for q, v in queries.items():
        want = sorted(((-float((w * np.array(v)).sum()), i) for i, w in fine if i != q))[:20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and [(-f[2], f[1]) for f in found] == want


def test_recall_on_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    some = rows.where("vec_id % 20 = 0")
    held = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").collect() if None not in r["embedding"]]
    ids, x = np.array([i for i, _ in held]), np.stack([v for _, v in held])
    got = {}
    for r in ann_bits.search(rows, some).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q, found in got.items():
        score = (x * x[ids == q][0]).sum(1)
        score[ids == q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        hits += len(found & set(ids[best].tolist()))
        total += len(best)
    assert len(got) >= 20 and hits >= 0.99 * total


def test_near_copies_store_no_set_that_meets_no_other(spark, monkeypatch):
    stored = []

    def seen(df, label, keep=False):
        out = materialize(df, label, keep)
        if "shingles" in out.columns:
            stored.append(out.where("shingles IS NOT NULL").count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", seen)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 40)
    texts = [" ".join(f"w{i}x{j}" for j in range(100)) for i in range(300)] + [" ".join(f"w7x{j}" for j in range(99))]
    kept = jaccard_join.keep_one_of_each(documents(spark, texts)).count()
    assert kept == 300
    assert stored and max(stored) <= 30, "all sets together take more disk than the texts"


def test_list_entries_are_shuffled_in_passes(spark, monkeypatch):
    stored = []

    def seen(df, label, keep=False):
        out = materialize(df, label, keep)
        if label == "lists":
            stored.append({r["list"] for r in out.select("list").collect()})
        return out

    monkeypatch.setattr(jaccard_join, "materialize", seen)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 20)
    texts = [" ".join(f"w{i // 3}x{j}" for j in range(100 - i % 3)) for i in range(150)]
    classes = jaccard_join.jaccard_classes(documents(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in classes} == {i: i - i % 3 for i in range(150)}
    assert len(stored) > 1 and not set.intersection(*stored)
    assert max(map(len, stored)) < 0.7 * len(set.union(*stored)), "a pass holds its own lists only"
