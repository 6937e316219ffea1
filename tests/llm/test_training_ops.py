"""Every numbered operator against a plain computation, on the smallest tables and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import exact_dedup, language_id, mixing, ngram_join, piece_bpe, sharding, tiff_media, token_store, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, n string, key string, digest string, shard int"


def odd_rows():
    long = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
    near = " ".join(f"w{i}" for i in range(200))
    texts = [
        None, "", "   ", "\t\n", "one", "one two", "One TWO", "a b c d e", "A  b\nc\td e", long, long + " tail", near, near + " more", near.replace("w7 ", "w7 q "),
        "é12% ▁ naïve ▁▁ x", "<|endoftext|> a <|endoftext|>", "<s> </s> <unk> <0x41>", "日本語のテキスト 😀😀 ok", "same text", "same text", "same  text", "a" * 50_000, "x    y", "tab\there  two   three", "\x00\x01\x1c nul",
        "Ünïcödé ÄÖÜ", "1234567890 12,345.67", "aaaaaaaabbbbbbbb" * 20, "  lead and trail  ", " ", "\r\n\r\n", "near �  private", "é combining",
    ]
    rows = [(i * 7, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None, "x", "y", "z", "k", "d", 3) for i, t in enumerate(texts)]
    return rows + [rows[18], (None, "no id", None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_shards_are_near_equal_and_gapless(spark, docs, odd, empty):
    for table, shards in ((docs, 24), (odd, 5)):
        found = rows_of(sharding.kd_shards(table, shards))
        source = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in table.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == source
        by = defaultdict(list)
        for r in found:
            by[r["shard"]].append(r)
        assert set(by) <= set(range(shards))
        for own in by.values():
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
        if table is docs:
            sizes = [sum(r["size"] for r in by[s]) for s in range(shards)]
            assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in found)
    assert sharding.kd_shards(empty).count() == 0


def pieces(texts):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for t in texts:
        ids = sp.encode(t or "")
        out.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return out


def test_pieces_equal_the_library(spark, docs, odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    for table in (docs, odd):
        given = table.collect()
        want = Counter((r["doc_id"], *p) for r, p in zip(given, pieces([r["text"] for r in given])))
        assert Counter(tuple(r) for r in piece_bpe.round_trip(table, path).collect()) == want
    assert piece_bpe.round_trip(empty, path).count() == 0
    back = piece_bpe.decode_column(piece_bpe.encode_column(docs, path), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_pieces_of_random_strings():
    import public_tokenizers

    draw = random.Random(5)
    alphabet = "abcdeott  \t\nAE▁éß日😀.,-'\"0123456789 \x07"
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(0, 60))) for _ in range(3000)] + ["aaaa" * draw.randrange(1, 40) for _ in range(50)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoder = piece_bpe.Encoder(public_tokenizers.path("piece_bpe_32k.model"))
    ids, at = encoder.encode(texts)
    for t, a, b in zip(texts, at[:-1], at[1:]):
        mine = ids[a:b].tolist()
        assert mine == sp.encode(t), repr(t)
        assert encoder.decode(mine) == sp.decode(mine), repr(t)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(pairs):
    """pairs of (doc_id, text) → {doc_id: smallest linked doc_id}"""
    sets = [(i, frozenset(shingles(t))) for i, t in pairs]
    unique = defaultdict(list)
    for i, s in sets:
        if s:
            unique[s].append(i)
    groups, where = list(unique), defaultdict(list)
    parent = list(range(len(groups)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(groups):
        for h in s:
            where[h].append(k)
    for k, s in enumerate(groups):
        shared = Counter(o for h in s for o in where[h] if o < k)
        for o, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(groups[o]) - n):
                parent[find(k)] = find(o)
    least = {}
    for k, s in enumerate(groups):
        least[find(k)] = min(least.get(find(k), 10**18), min(unique[s]))
    at = {s: least[find(k)] for k, s in enumerate(groups)}
    return {i: at[s] if s else i for i, s in sets}


def near_copies(spark, n=400):
    draw, rows = random.Random(3), []
    base = [[f"t{draw.randrange(3000)}" for _ in range(draw.randrange(5, 120))] for _ in range(n // 8)]
    for i in range(n):
        words = list(base[draw.randrange(len(base))])
        for _ in range(draw.randrange(0, 4)):
            words[draw.randrange(len(words))] = f"z{draw.randrange(50)}"
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_components_equal_brute_force(spark, docs, odd, empty, monkeypatch):
    crowd = near_copies(spark)
    for table, chunk in ((docs, 1500), (odd.where("doc_id IS NOT NULL"), 1500), (crowd, 1500), (crowd, 7)):
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        given = [(r["doc_id"], r["text"]) for r in table.collect()]
        want = components(given)
        found = rows_of(ngram_join.jaccard_components(table))
        assert len(found) == len(given)
        sizes = {i: len(shingles(t)) for i, t in given}
        for r in found:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], sizes[r["doc_id"]]), r
    assert ngram_join.jaccard_components(empty).count() == 0
    assert ngram_join.jaccard_components(odd).count() == odd.count()
    kept = ngram_join.one_of_each(crowd)
    assert {r["doc_id"] for r in kept.collect()} == set(components([(r["doc_id"], r["text"]) for r in crowd.collect()]).values())


def reshared(sizes, weights, most=3):
    """Targets by repeated resharing, source by source."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left, by = total - sum(fixed.values()), sum(weights[s] for s in free)
        share = {s: left * weights[s] / by for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets(spark, docs, odd, empty):
    for table in (docs, odd):
        found = rows_of(mixing.mix(table))
        given = table.collect()
        assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in given)
        sizes = Counter()
        for r in given:
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = reshared(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
        taken, largest = Counter(), Counter()
        of = {(r["doc_id"], len(WORD.findall(r["text"] or ""))): r["source"] for r in given}
        for r in found:
            s = of[r["doc_id"], r["size"]]
            assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
            assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
            taken[s] += r["taken"]
            largest[s] = max(largest[s], r["size"])
        if table is docs:
            assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
            again = rows_of(mixing.mix(table.repartition(3)))
            assert sorted(map(str, again)) == sorted(map(str, found))
            copies = Counter(r["doc_id"] for r in mixing.mixed_documents(table).select("doc_id").collect())
            assert copies == Counter({r["doc_id"]: r["taken"] // r["size"] for r in found if r["size"] and r["taken"]}) + Counter({i: n for i, n in copies.items() if not dict((r["doc_id"], r["size"]) for r in found)[i]})
    assert mixing.mix(empty).count() == 0


def test_language_is_found(spark, docs, odd, empty):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(big).join(big.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97
    fixed = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    for r in docs.collect():
        assert fixed[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    strange = language_id.identify(odd).collect()
    assert len(strange) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "und") for r in strange)
    assert language_id.identify(empty).count() == 0
    assert language_id.accepted(odd).columns == odd.columns


def test_language_is_learned_from_all_of_a_text(spark):
    parts = [chr(97 + k) * 6 for k in range(16)]
    long = " ".join(p for p in parts for _ in range(1_000))
    rows = spark.createDataFrame([(i, long, "xx") for i in range(8)] + [(9, "é" * 3_999 + "z", "yy")], "doc_id long, text string, lang string")
    found = language_id.learn(rows)
    assert all(p.encode() in found["xx"] for p in parts) and found["yy"] == ("é" * 3_999 + "z").encode()
    assert long.encode() in found["xx"] and len(found["xx"]) <= language_id.LEARN_BYTES
    huge = spark.createDataFrame([(1, "a b " * language_id.LEARN_BYTES, "xx"), (2, "c d " * language_id.LEARN_BYTES + "e", "xx"), (3, "short text", "yy")], "doc_id long, text string, lang string")
    assert language_id.learn(huge)["xx"][:3] == b"a b" and language_id.learn(huge.unionByName(rows))["xx"][:3] != b"a b"


def test_language_needs_a_letter(spark):
    rows = spark.createDataFrame([(1, "½ ²³ ①", "en"), (2, "Ⅷ", "en"), (3, "12, 7!", "en"), (4, None, "en"), (5, "plain words here", "en"), (6, "d'autres mots", "fr")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in language_id.identify(rows).collect()}
    assert all(found[i] == ("und", 0.0, True) for i in (1, 2, 3, 4)) and {found[5][0], found[6][0]} <= {"en", "fr"}
    assert {r["doc_id"] for r in language_id.accepted(rows).collect()} <= {5, 6}


def test_language_equals_plain_compression(spark, docs):
    """Each text with each dictionary, by zstandard itself."""
    import zstandard

    known = language_id.learn(docs)
    made = {}
    for level in (3, 19):
        for g, d in known.items():
            z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made[g, level] = zstandard.ZstdCompressor(level=level, dict_data=z, write_content_size=False, write_checksum=False, write_dict_id=False)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language_id.identify(docs).collect():
        text = texts[r["doc_id"]]
        body = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip().encode()
        if not body:
            assert r["lang_pred"] == "und"
            continue
        for level in (3, 19):
            sizes = sorted((sum(len(made[g, level].compress(body[k : k + 65_536])) for k in range(0, len(body), 65_536)), i, g) for i, g in enumerate(known))
            margin = (sizes[1][0] - sizes[0][0]) / sizes[0][0]
            if margin > language_id.NARROW:
                break
        assert (r["lang_pred"], r["rejected"]) == (sizes[0][2], margin < language_id.NARROW) and abs(r["margin"] - margin) < 1e-12


def test_many_languages_go_in_groups(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i} of many words", f"junk{i % 300}") for i in range(900)], "doc_id long, text string, lang string")
    known = language_id.learn(rows)
    texts = [None, "", *(r["text"] for r in rows.limit(40).collect())]
    assert len(known) == 300
    grouped = language_id.Classifier(known).classify(texts)
    monkeypatch.setattr(language_id, "GROUP", 1_000)
    assert grouped == language_id.Classifier(known).classify(texts)


def test_language_of_a_very_long_text(spark):
    """A clean text's margin doesn't fall with its length."""
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    body = "\n".join(r["text"] for r in big.where("lang = 'en'").orderBy("doc_id").select("text").collect())
    assert len(body) >= 10_000_000
    c = language_id.Classifier(language_id.learn(big))
    for n in (200_000, 10_000_000):
        lang, _, margin, rejected = c.classify([body[:n]])[0]
        assert (lang, rejected) == ("en", False) and margin > 2 * language_id.NARROW, (n, margin)


def test_toxicity(spark, docs, odd, empty):
    big, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(big, toxicity.learn(big, labels)).join(labels, "doc_id").where("held_out").collect()
    hits = Counter((r["toxic"], r["predicted"]) for r in found)
    assert hits[1, 1] >= 0.75 * (hits[1, 1] + hits[1, 0]) and hits[0, 1] <= 0.01 * (hits[0, 0] + hits[0, 1]), hits
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    strange = toxicity.score(odd, toxicity.learn(odd, none)).collect()
    assert len(strange) == odd.count() and all(0 <= r["score"] <= 1 for r in strange)
    assert toxicity.score(empty, toxicity.learn(empty, none)).count() == 0


def test_toxicity_of_one_kind_or_one_document(spark, docs, monkeypatch):
    """With labels of one kind the bias alone says so; a document in very many rows is learned from in part."""
    for kind in (0, 1):
        labels = docs.select("doc_id", F.lit(kind).alias("quality"), F.lit(kind).alias("toxic"))
        scores = [r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()]
        assert all(s > 0.9 if kind else s < 0.1 for s in scores)
    monkeypatch.setattr(toxicity, "MOST_COORDINATES", 50)
    rows = spark.createDataFrame([(1, f"some bad words {i}") for i in range(40)], "doc_id long, text string")
    assert len(toxicity.learn(rows, spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int"))[0])


def test_ids_beside_a_null(spark, tmp_path):
    """Ids that a double can't hold stay as they are in a batch with a null id."""
    import public_tokenizers

    ids = [2**53 + 1, None, -1, 3]
    rows = spark.createDataFrame([(i, f"text {i}", "en") for i in ids], "doc_id long, text string, lang string").coalesce(1)
    model = public_tokenizers.path("piece_bpe_32k.model")
    for made in (
        piece_bpe.round_trip(rows, model), piece_bpe.decode_column(piece_bpe.encode_column(rows, model), model), tiff_media.media_features(tiff_media.store_texts(rows)),
        language_id.identify(rows), toxicity.score(rows, toxicity.learn(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))), exact_dedup.exact_dedup(rows),
    ):
        assert sorted(r["doc_id"] or 0 for r in made.collect()) == sorted(i or 0 for i in ids), made.columns


def test_toxicity_equals_plain_ftrl(spark, docs):
    """The same sample through a plain dict version, one coordinate at a time."""
    import math

    import numpy as np
    import pyarrow as pa

    from cloakwork.llm.words import text_bytes

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    at, w = toxicity.learn(docs, labels)
    toxic = {r["doc_id"]: r["toxic"] for r in labels.where("toxic IS NOT NULL").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)).alias("h")).collect()}
    rows = []
    for r in docs.collect():
        if r["doc_id"] in toxic:
            x = toxicity.features(*text_bytes(pa.array([r["text"] or ""])))[0]
            rows.append((order[r["doc_id"]], x.tobytes(), [*x.tolist(), 1 << toxicity.BITS], toxic[r["doc_id"]]))
    rows.sort(key=lambda x: x[:2])
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0 if i == 1 << toxicity.BITS else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    draw = np.random.default_rng(7)
    for _ in range(toxicity.PASSES):
        for k in draw.permutation(len(rows)).tolist():
            _, _, x, y = rows[k]
            ws = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(ws.values()))))) - y
            for i in x:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * ws[i]
                n[i] += g * g
    want = {i: weight(i) for i in z if weight(i)}
    assert set(at.tolist()) == set(want) and all(abs(want[i] - v) < 1e-6 for i, v in zip(at.tolist(), w.tolist()))


def test_toxicity_sample_is_bounded(spark, docs, monkeypatch):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    whole = toxicity.learn(docs, labels)
    monkeypatch.setattr(toxicity, "MOST_COORDINATES", 20_000)
    less = toxicity.learn(docs, labels)
    monkeypatch.setattr(toxicity, "MOST_COORDINATES", 0)
    assert len(whole[0]) > len(less[0]) > 0 == len(toxicity.learn(docs, labels)[0])


def plain_dedup(given):
    by = defaultdict(list)
    for r in given:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return Counter((i, least(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids)


def test_dedup(spark, docs, odd, empty):
    for table in (docs, odd):
        given, found = table.collect(), exact_dedup.exact_dedup(table).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == plain_dedup(given)
        assert sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})
        assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
        kept = exact_dedup.kept_documents(table)
        assert kept.columns == table.columns and kept.count() == sum(r["kept"] for r in found)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_dedup_index_takes_and_gives_back(spark, docs):
    digests = exact_dedup.digests_of(docs).cache()
    half, rest = digests.where("doc_id % 2 = 0"), digests.where("doc_id % 2 = 1")
    whole = {bytes(r["digest"]): r["n"] for r in exact_dedup.build_index(digests).collect()}
    index = exact_dedup.build_index(half)
    grown = exact_dedup.update_index(index, inserts=rest)
    assert {bytes(r["digest"]): r["n"] for r in grown.collect()} == whole
    back = exact_dedup.update_index(grown, deletes=rest)
    assert {bytes(r["digest"]): r["n"] for r in back.collect()} == {bytes(r["digest"]): r["n"] for r in index.collect()}


def test_dedup_index_names_no_dead_row(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["same", "same", "other", "same", "one"])], "doc_id long, text string")
    digests = exact_dedup.digests_of(docs).cache()
    index = exact_dedup.build_index(digests)
    gone, left = digests.where("doc_id IN (0, 2, 3)"), digests.where("doc_id NOT IN (0, 2, 3)")
    plain = {bytes(r["digest"]): r["doc_id"] for r in left.collect()}
    stale = exact_dedup.update_index(index, deletes=gone).collect()
    assert {bytes(r["digest"]): (r["n"], r["stale"]) for r in stale} == {d: (1, i == 1) for d, i in plain.items()}
    assert all(r["best"] == (exact_dedup.NO_ID if r["stale"] else plain[bytes(r["digest"])]) for r in stale)
    fresh = exact_dedup.update_index(index, deletes=gone, live=left).collect()
    assert {bytes(r["digest"]): (r["best"], r["n"], r["stale"]) for r in fresh} == {d: (i, 1, False) for d, i in plain.items()}
    again = exact_dedup.update_index(exact_dedup.update_index(index, deletes=gone), inserts=digests.where("doc_id = 3")).collect()
    assert {r["stale"] for r in again if r["n"] == 2} == {True}


def test_cuckoo_filter_grows():
    bucket = exact_dedup.Bucket(8)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        bucket.add(k, i, i, 1)
    assert bucket.resizes and all(k in bucket.filter for k in keys)
    for k in keys[:2500]:
        bucket.remove(k, keys.index(k), keys.index(k), 1)
    assert set(bucket.keys) == set(keys[2500:]) and all(k in bucket.filter for k in keys[2500:])
    assert sum(k in bucket.filter for k in keys[:2500]) < 50


def stream(given):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for r in given:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)), ids))
        start += len(ids)
    return out


def test_token_store(spark, docs, odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    for table in (docs, odd):
        given = sorted(table.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        store = token_store.write_store(table, path, end=2)
        want = stream(given)
        assert Counter(tuple(r) for r in token_store.read_digests(spark, store).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == Counter(w[:4] for w in want)
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in token_store.read_documents(spark, store).collect()) == Counter((w[0], tuple(w[4])) for w in want)
        assert token_store.verify(spark, store).count() == 0
    store = token_store.write_store(empty, path, end=2)
    assert token_store.read_digests(spark, store).count() == 0


def test_altered_recipes_are_found(spark, docs):
    import public_tokenizers

    store = token_store.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    recipes = store.table(spark, "recipes")
    schema, sound = recipes.schema, [r.asDict() for r in recipes.collect()]
    names = lambda r: [bytes(r["digests"][k : k + 16]) for k in range(0, len(r["digests"]), 16)]
    many = next(i for i, r in enumerate(sound) if len(set(names(r))) > 1)
    turned = {"digests": bytearray(b"".join(names(sound[many])[::-1])), "sizes": sound[many]["sizes"][::-1]}
    for change in (turned, {"doc_id": -5}, {"doc_id": None}, {"n_tokens": sound[many]["n_tokens"] + 1}, {"digests": sound[many - 1]["digests"], "sizes": sound[many - 1]["sizes"]}, None):
        rows = [r | change if i == many else r for i, r in enumerate(sound)] if change else sound[:many] + sound[many + 1 :]
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{store.path}/recipes")
        for read in (token_store.read_digests, token_store.read_documents):
            with pytest.raises(ValueError, match="differ from the manifest"):
                read(spark, store).collect()
    spark.createDataFrame(sound, schema).write.mode("overwrite").parquet(f"{store.path}/recipes")
    assert token_store.read_digests(spark, store).count() == len(sound)
    assert store.table(spark, "manifest").where("part = -1").count() == 1
    nodes = store.table(spark, "manifest").collect()
    for lost in (n for n in nodes if n["block"] == -1):
        rest = [n for n in nodes if n != lost]
        spark.createDataFrame(rest, "part int, block long, root string").write.mode("overwrite").parquet(f"{store.path}/manifest")
        assert token_store.verify(spark, store).count() == 1


def plain_cuts(ids):
    """Chunk ends of one document, one id after the other: a hash of the last 32 ids decides."""
    gear, ends, last = token_store._GEAR.tolist(), [], 0
    for c in range(1, len(ids) + 1):
        h = 0
        for k, i in enumerate(reversed(ids[max(0, c - 32) : c])):
            h += (gear[i & 0xFFFF] + (i >> 16)) << k
        if (c - last >= token_store.LEAST and h % 2**64 & 255 << 40 == 0 and c >= token_store.LEAST) or c - last == token_store.MOST or c == len(ids):
            last = c
            ends.append(c)
    return ends


def test_chunks_are_cut_by_content():
    import numpy as np

    draw = np.random.default_rng(4)
    docs = [draw.integers(0, 50_000, n) for n in (0, 1, 63, 64, 65, 700, 5_000)] + [np.zeros(5_000, np.int64)]
    flat, ends = np.concatenate(docs), np.cumsum([0, *map(len, docs)])
    marks = token_store.cut_marks(flat)
    for d, a, b in zip(docs, ends[:-1], ends[1:]):
        mine = (marks[(marks > a) & (marks <= b)] - a).tolist()
        assert token_store.cut_points(mine, len(d)) == plain_cuts(d.tolist())


def test_tiff_payloads(spark, docs, odd, empty):
    for table in (docs, odd):
        media = tiff_media.store_texts(table)
        found = {}
        for r in tiff_media.media_features(media).collect():
            found.setdefault(r["doc_id"], []).append(r)
        assert sum(map(len, found.values())) == table.count()
        for r in table.collect():
            body = (r["text"] or "").encode()
            padded = body.ljust(max(1, -(-len(body) // 192)) * 192, b" ")
            want = (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
            assert want in [(x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) for x in found[r["doc_id"]]]
    assert tiff_media.media_features(tiff_media.store_texts(empty)).count() == 0


def test_tiff_schemes_round_trip(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    images = [draw.integers(0, 4, (37, 50, 3)).astype(np.uint8), np.zeros((130, 3, 1), np.uint8), draw.integers(0, 256, (64, 90, 3)).astype(np.uint8)]
    files = []
    for scheme in (1, 5, 8, 32773, 32946):
        for predictor in (1, 2):
            for tile in (None, (16, 32)):
                for order in "<>":
                    data = tiff_media.write_tiff(images, scheme, predictor, 16, tile, order)
                    assert all(np.array_equal(p.pixels, i) for p, i in zip(tiff_media.pages(data), images, strict=True))
                    files.append((len(files), bytearray(data)))
    files += [(900, None), (901, bytearray(b"")), (902, bytearray(b"not an image")), (903, bytearray(files[0][1][:60]))]
    table = spark.createDataFrame(files, "file int, body binary")
    found = tiff_media.tiff_pages(table, "file", "body").groupBy("file").agg(F.count("page").alias("pages"), F.count("error").alias("errors")).collect()
    assert Counter((r["pages"], r["errors"]) for r in found) == Counter({(3, 0): 40, (0, 1): 2})


def plain_tiff(images, order):
    """(bits or None, planar, scheme, image) each → a page of one strip a plane; a scheme without name is written plain."""
    import numpy as np

    out, link = bytearray((b"II" if order == "<" else b"MM") + tiff_media.struct.pack(order + "HI", 42, 0)), 4
    for bits, planar, scheme, image in images:
        height, width, samples = image.shape
        strips = []
        for plane in [image[:, :, c : c + 1] for c in range(samples)] if planar == 2 else [image]:
            flat = plane.reshape(height, -1)
            body = flat.astype(order + "u2").tobytes() if bits == 16 else flat.tobytes() if bits == 8 else np.packbits(flat, axis=1).tobytes()
            strips.append((len(out), body := tiff_media._PACK.get(scheme, bytes)(body)))
            out += body
        arrays = len(out)
        out += tiff_media.struct.pack(f"{order}{2 * len(strips)}I", *[p for p, _ in strips], *[len(b) for _, b in strips])
        fields = [(256, width), (257, height), (258, bits), (259, scheme), (273, strips[0][0]), (277, samples), (278, height), (279, len(strips[0][1])), (284, planar)]
        fields = [(t, 1, v) if len(strips) == 1 or t not in (273, 279) else (t, len(strips), arrays + (t == 279) * 4 * len(strips)) for t, v in fields if v]
        tiff_media.struct.pack_into(order + "I", out, link, len(out))
        out += tiff_media.struct.pack(order + "H", len(fields)) + b"".join(tiff_media.struct.pack(order + "HHII", t, 4, n, v) for t, n, v in fields)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def test_tiff_depths_planes_and_bad_pages(spark):
    import numpy as np

    draw = np.random.default_rng(2)
    scan, deep, rgb = draw.integers(0, 2, (9, 21, 1)).astype(np.uint8), draw.integers(0, 65536, (7, 5, 3)).astype("<u2"), draw.integers(0, 256, (6, 11, 3)).astype(np.uint8)
    good = [(1, 1, 32773, scan), (None, 1, 1, scan), (16, 1, 8, deep), (16, 2, 5, deep), (8, 2, 32773, rgb)]
    for order in "<>":
        assert all(np.array_equal(p.pixels, g[3]) for p, g in zip(tiff_media.pages(plain_tiff(good, order)), good, strict=True))
        mixed = plain_tiff([(8, 1, 8, rgb), (1, 1, 4, scan), (16, 1, 8, deep)], order)
        rows = tiff_media.tiff_pages(spark.createDataFrame([(1, bytearray(mixed))], "file int, body binary"), "file", "body").collect()
        assert [r["page"] for r in rows] == [0, None, 2] and [bool(r["error"]) for r in rows] == [False, True, False]
        assert rows[0]["pixels"] == rgb.tobytes() and rows[2]["pixels"] == deep.tobytes() and "page 1" in rows[1]["error"]


def test_quality(spark, docs, odd, empty):
    from cloakwork.llm import quality

    big, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.resample(big, labels).cache()
    assert found.count() == big.count() and abs(found.where("kept").count() - quality.KEEP * big.count()) <= 2
    assert found.where("kept").agg(F.min("gumbel_key")).first()[0] >= found.where("NOT kept").agg(F.max("gumbel_key")).first()[0] - 1e-6
    held = found.where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r["log_weight"] for r in held if r["quality"] == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / len(good) / len(bad) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    strange = quality.resample(odd, none).collect()
    assert len(strange) == odd.count() and {r["log_weight"] for r in strange} == {0.0}
    assert quality.resample(empty, none).count() == 0


def test_quality_equals_plain_counts(spark, docs):
    """Counts of hashed n-grams one by one, with the words' hashes taken over."""
    import numpy as np
    import pyarrow as pa

    from cloakwork.llm import quality
    from cloakwork.llm.words import mix, text_bytes, word_hashes

    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = {r["doc_id"]: (r["n_grams"], r["log_ratio"], r["log_weight"]) for r in quality.log_weights(docs, quality.learn(docs, labels)).collect()}
    of = lambda x: int(mix(np.array([x % 2**64], np.uint64))[0]) % quality.BUCKETS
    raw, target, grams = Counter(), Counter(), {}
    for r in docs.collect():
        words = word_hashes(*text_bytes(pa.array([r["text"] or ""])))[0].tolist()
        grams[r["doc_id"]] = [of(w) for w in words] + [of(a * int(quality._PAIR) + b) for a, b in zip(words, words[1:])]
        raw.update(grams[r["doc_id"]])
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            target.update(grams[r["doc_id"]])
    n, m = raw.total() + quality.BUCKETS, target.total() + quality.BUCKETS
    ratio = {b: np.log((target[b] + 1) / m) - np.log((raw[b] + 1) / n) for b in raw}
    for i, g in grams.items():
        total = sum(ratio[b] for b in g)
        assert got[i][0] == len(g) and abs(got[i][1] - total) < 1e-6 and abs(got[i][2] - 200 * total / max(1, len(g))) < 1e-6


#: Names and kinds that a user's columns may have: internal ones, signs, and a map, which can't be compared.
CLASHING = "doc_id long, text string, lang string, source string, `__digest` string, `__found` string, `__doc_id` long, `a.b` string, `_digest0` string, `_extra0` int, `_id0_0` long, `doc` string, `tags` map<string,int>, `x``y` int"


@pytest.mark.parametrize("stage", [language_id.accepted, exact_dedup.kept_documents, ngram_join.one_of_each, mixing.mixed_documents])
def test_documents_keep_clashing_columns(spark, stage):
    texts = ["the same words in a row here", "the same words in a row here", "other words for another text, quite long", None, "", "the  same words in a row here"]
    rows = [(i, t, "en", None if i == 2 else "s", "d", "f", i, "dot", "own", 5, 6, "doc", {"k": i}, 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[1], (None, *rows[1][1:])], CLASHING)
    out = stage(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    given, kept = Counter(map(str, docs.collect())), Counter(map(str, out.collect()))
    assert kept and set(kept) <= set(given)
    if stage is exact_dedup.kept_documents:
        assert kept.total() == 3 == len(kept)
    if stage is ngram_join.one_of_each:
        assert kept.total() == 5  # rows without words, and those without an id, stay
    assert stage(docs.where("false")).count() == 0


def test_mix_takes_the_least_keys(spark, docs):
    """By sorting: complete epochs, and the prefix nearest to the rest in the order of keys."""
    for table, rows_a_window in ((docs, 4_096), (docs, 5)):
        old, mixing.WINDOW_ROWS = mixing.WINDOW_ROWS, rows_a_window
        try:
            taken = Counter()
            for r in mixing.mix(table).collect():
                taken[r["doc_id"]] += r["taken"]
        finally:
            mixing.WINDOW_ROWS = old
        by, sizes = defaultdict(list), Counter()
        for r in mixing.measured(table).collect():
            by[r["source"]].append((r["key"], r["doc_id"], r["size"]))
            sizes[r["source"]] += r["size"]
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = Counter()
        for s, target in reshared(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}).items():
            epochs = int(target / sizes[s] + 1e-12)
            rest, upto, cuts = target - epochs * sizes[s], 0, [(0.0, 0)]
            rows = sorted(x for x in by[s] if x[2])
            for k, x in enumerate(rows, 1):
                upto += x[2]
                cuts.append((upto, k))
            best = min(cuts, key=lambda c: (abs(c[0] - rest), c[1] == 0, c[1]))[1]
            for k, x in enumerate(rows):
                want[x[1]] += x[2] * (epochs + (k < best))
        assert +taken == +want


def test_shards_equal_a_plain_tree(spark, docs):
    """Recursive cuts of sorted rows along the widest dimension."""
    rows = [r.asDict() for r in sharding.metadata(docs).collect()]
    dims = [f"d{i}" for i in range(4)]
    whole = {d: max(1, max(r[d] for r in rows) - min(r[d] for r in rows)) for d in dims}

    def split(own, shards, first):
        if shards == 1:
            return {r["row"]: first for r in own}
        if not own:
            return {}
        widest = max(dims, key=lambda d: (max(r[d] for r in own) - min(r[d] for r in own)) / whole[d])
        own = sorted(own, key=lambda r: (r[widest], r["tie"], r["row"]))
        target, upto, best = sum(r["size"] for r in own) * (shards // 2) / shards, 0, (0, 0)
        off = [(target, 0)]
        for k, r in enumerate(own, 1):
            upto += r["size"]
            off.append((abs(upto - target), k))
        best = min(off, key=lambda x: (x[0], x[1] == 0, x[1]))[1]
        return split(own[:best], shards // 2, first) | split(own[best:], shards - shards // 2, first + shards // 2)

    want = Counter((r["doc_id"], s) for r in rows for s in [split_of[r["row"]]]) if (split_of := split(rows, 24, 0)) else None
    assert Counter((r["doc_id"], r["shard"]) for r in sharding.kd_shards(docs).collect()) == want


def test_shards_see_whole_strings(spark):
    """Sources that begin alike are told apart, and ranks have no gaps."""
    docs = spark.createDataFrame([(i, "x" * 50, f"https://example.org/{i % 40:02d}") for i in range(400)], "doc_id long, text string, source string")
    ranks = {r["value"]: r["rank"] for r in sharding.ranks(docs, "source").collect()}
    assert ranks == {v: k for k, v in enumerate(sorted(ranks))} and len(ranks) == 40
    found = sharding.kd_shards(docs, 4, ("source",)).join(docs, "doc_id")
    assert found.groupBy("source").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0


def test_damaged_tiffs_give_error_rows(spark):
    import numpy as np

    image = np.arange(8 * 10 * 3).reshape(8, 10, 3).astype(np.uint8)

    def file(edit=None, tile=None, scheme=1):
        data = bytearray(tiff_media.write_tiff([image], scheme, tile=tile))
        at = tiff_media.struct.unpack_from("<I", data, 4)[0]
        for k in range(tiff_media.struct.unpack_from("<H", data, at)[0]):
            tag = tiff_media.struct.unpack_from("<H", data, at + 2 + 12 * k)[0]
            if edit and tag in edit:
                tiff_media.struct.pack_into("<I", data, at + 10 + 12 * k, edit[tag])
        return data

    bad = [
        file({tiff_media.TILE_WIDTH: 0}, (16, 16)), file({tiff_media.TILE_HEIGHT: 0}, (16, 16)), file({tiff_media.HEIGHT: 2**31}), file({tiff_media.WIDTH: 2**31 - 1, tiff_media.HEIGHT: 2**31 - 1}), file({tiff_media.ROWS_PER_STRIP: 0}),
        file({tiff_media.STRIP_SIZES: 30}), file({tiff_media.STRIP_SIZES: 0}), file({tiff_media.WIDTH: 0}), bytearray(b"II*\0\0\0\0\0"), file({tiff_media.STRIP_SIZES: 9}, scheme=8), file({tiff_media.STRIP_OFFSETS: 2**31}),
    ]
    table = spark.createDataFrame([(i, f"n{i}", b) for i, b in enumerate([*bad, file()])], "file int, name string, body binary")
    rows = tiff_media.tiff_pages(table, "file", "body", ("name",)).orderBy("file").collect()
    assert [r["file"] for r in rows] == list(range(len(bad) + 1)) and all(r["error"] and r["pixels"] is None for r in rows[:-1])
    assert rows[-1]["error"] is None and rows[-1]["pixels"] == image.tobytes() and rows[-1]["name"] == f"n{len(bad)}"


def test_texts_are_stored_in_all_ways(spark, docs):
    media = tiff_media.store_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = tiff_media.tiff_pages(media, "doc_id", "media").groupBy("compression", "predictor").count().collect()
    assert {(r["compression"], r["predictor"]) for r in found} == {(c, p) for c in (tiff_media.PACKBITS, tiff_media.LZW, tiff_media.DEFLATE) for p in (1, 2)}


def test_packers_equal_their_readers():
    draw = random.Random(6)
    for n in (0, 1, 2, 3, 127, 128, 129, 130, 257, 4_000, 60_000):
        for letters in (1, 2, 200):
            data = bytes(draw.choices(range(letters), k=n))
            assert tiff_media.unpack_bits(tiff_media.pack_bits(data)) == data == tiff_media.unpack_lzw(tiff_media.pack_lzw(data))


def test_scratch_goes(spark):
    from cloakwork.llm import common

    with common.scratch(spark):
        table = common.materialize(spark.range(3), "try")
        path = table.inputFiles()[0]
    assert not __import__("os").path.exists(path.removeprefix("file://"))
    kept = common.written(spark.range(3), "try")
    assert kept.count() == 3
    common.discard(kept)
    common.discard(kept)
