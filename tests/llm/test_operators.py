"""Every operator against a brute-force version, on documents with nulls, empty and
very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from candleworks.llm import components, decontam, embeddings, langid, mixing, ordinals, packing, pii, quality, sharding, shingles, simhash, tokenout
from candleworks.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, score double, shard int, spans string"
FILLER = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()


def clash(texts):
    """Rows with columns named like results of the operators."""
    return [(i, t, "en", 0.5, 7, "old") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocabulary = ["the", "and", "Straße", "über", "maison", "où", "casa", "niño"] + [f"w{i}" for i in range(60)]
    some = [" ".join(rng.choice(vocabulary, size=int(n))) for n in rng.integers(1, 120, size=60)]
    return some + [None, "", "   \n\t ", some[0], some[0], some[1], "x" * 30_000, " ".join(FILLER), "!!! ??? 123", "a b İstanbul \U0001f600 tail"] + [" ".join(rng.choice(vocabulary, size=9000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(clash(texts), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- decontamination


def brute_hits(text, items, window=13):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, who = split(text), set(), set()
    for item, item_text in items:
        own = split(item_text)
        n = min(window, len(own))
        wanted = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in wanted:
                hit |= set(range(i, i + n))
                who.add(str(item))
    return len(words), len(hit), sorted(who)


def test_decontaminate(spark, docs, texts, nothing):
    long = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    items = [(1, long), (2, "short Item"), (10, "short item"), (3, None), (4, "?!"), (5, " ".join(FILLER)), (5, "w1 w2")]
    more = ["before " + long.upper() + " after", "ALPHA-beta gamma", "a short ITEM!", "w1 w2 " * 40]
    everything = spark.createDataFrame(clash([*texts, *more]), SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.decontaminate(everything, bench).collect()
    assert len(rows) == len(texts) + len(more)
    for r in rows:
        n, hit, who = brute_hits(r.text, items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, who)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        assert sum(len(re.findall(r"[\w]+", r.text[s.start : s.end])) for s in r.hits) >= len(r.hits)
        assert r.shard == 7 and r.spans == "old"
    clean = decontam.decontaminate(everything, bench, only_clean=True)
    assert clean.columns == everything.columns and clean.count() == sum(not r.contaminated for r in rows)
    assert decontam.decontaminate(nothing, bench).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(docs, bench.limit(0)).collect())
    with pytest.raises(ValueError):
        decontam.decontaminate(docs, bench, max_bytes=1)


# ---------------------------------------------------------------- sharding


def smallest_capacity(sizes, shards):
    def walk(capacity):
        n, room = 0, 0
        for s in sizes:
            if s > capacity:
                n, room = n + 1, 0
            elif s > room:
                n, room = n + 1, capacity - s
            else:
                room -= s
        return n

    low, high = 0, sum(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if walk(middle) <= shards else (middle, high)
    return high


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shard(docs, texts, nothing, shards):
    rows = sharding.shard(docs.withColumn("digest", F.col("spans")), shards).collect()
    assert {r.digest for r in rows} == {"old"}
    groups = {}
    for t in texts:
        raw = (t or "").encode()
        groups[hashlib.md5(raw).hexdigest()] = groups.get(hashlib.md5(raw).hexdigest(), 0) + len(raw) + 8
    sizes = [groups[k] for k in sorted(groups)]
    best, loads, of, slots = smallest_capacity(sizes, shards), Counter(), {}, {}
    for r in rows:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "bytes")
        assert of.setdefault(raw, r.shard) == r.shard and 0 <= r.shard < shards
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(texts) and max(loads.values()) <= max(best, max(sizes))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(nothing, shards).count() == 0


def test_shard_search_is_exact_and_even():
    rng = np.random.default_rng(1)
    for n, shards in ((40, 4), (300, 24), (5, 24)):
        sizes = rng.integers(1, 1000, size=n)
        capacity, cuts, split = sharding.search(sizes, np.ones(n, bool), shards)
        assert not split and capacity == smallest_capacity(sizes.tolist(), shards)
        back = sharding.search(sizes[::-1], np.ones(n, bool), shards)[1]
        even = [0, *sharding.even_cuts(sizes, capacity, shards, cuts, back), n]
        assert max(int(sizes[a:b].sum()) for a, b in zip(even, even[1:], strict=False)) <= max(capacity, int(sizes.max()))


@pytest.mark.parametrize("part", [[], [0.1], [1 / 3], [0.3, 0.1, 0.1], [0.045, 0.05]])
def test_large_groups_leave_the_other_shards_even(spark, part):
    """Groups of a third, a tenth and about an even share of all bytes, 24 shards."""
    rng = np.random.default_rng(6)
    rows = [(i, f"{i} " + "x" * int(n)) for i, n in enumerate(rng.integers(1, 400, size=20_000))]
    rest = sum(len(t) + 8 for _, t in rows)
    whole = rest / (1 - sum(part))
    for k, share in enumerate(part):
        text = f"copy {k} " + "y" * 1000
        rows += [(30_000 + 1000 * k + i, text) for i in range(int(whole * share) // (len(text) + 8))]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), keep=["doc_id"])
    loads = {r.shard: r.n for r in found.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert sorted(loads) == list(range(24))
    planted = [int(whole * share) // (len(f"copy {k} ") + 1008) * (len(f"copy {k} ") + 1008) for k, share in enumerate(part)]
    others = sorted(loads.values())[: 24 - len(part)]
    assert sorted(loads.values())[24 - len(part) :] == sorted(planted)
    assert others[0] > 0.95 * others[-1]


def test_positions(spark):
    rows = spark.createDataFrame([(i % 3 if i % 5 else None, i // 7) for i in range(200)] * 2, "g int, o int")
    found = ordinals.positions(rows, "g", ["o"]).collect()
    by = {}
    for r in found:
        by.setdefault(r.g, []).append((r.slot, r.o))
    for pairs in by.values():
        pairs.sort()
        assert [s for s, _ in pairs] == list(range(len(pairs))) and [o for _, o in pairs] == sorted(o for _, o in pairs)


# ---------------------------------------------------------------- simhash


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union_find(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("most", [1024, 2])
def test_simhash(docs, texts, nothing, most):
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs, most=most).withColumn("hex", simhash.hexadecimal()).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    close = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert [rows[i].hex for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in range(len(texts))] == union_find(len(texts), close)
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("most", [1024, 4])
def test_simhash_links_connect_dense_groups(spark, most):
    """Hundreds of fingerprints a few bits around common centres, cut into thirds."""
    rng = np.random.default_rng(8)
    values = {int(rng.integers(0, 1 << 63)) for _ in range(30)}
    for centre in list(values)[:3]:
        for _ in range(150):
            flips = rng.choice(64, size=int(rng.integers(1, 4)), replace=False)
            values.add(centre ^ sum(1 << int(b) for b in flips))
    values = sorted(values)
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in values], "fingerprint long")
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(nodes, most).collect()]
    at = {v: i for i, v in enumerate(values)}
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    close = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    assert union_find(len(values), [(at[a], at[b]) for a, b in got]) == union_find(len(values), close)


def test_one_of_each(docs, texts):
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == {r.component_id for r in simhash.near_duplicates(docs).collect()}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 200), (5, None)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# ---------------------------------------------------------------- personal data


def brute_spans(text):
    out = []
    text = text or ""
    for m in re.finditer(pii.BASE_PATTERNS["email"], text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(pii.BASE_PATTERNS["ip"], text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(pii.BASE_PATTERNS["card"], text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(pii.BASE_PATTERNS["phone"], text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


PERSONAL = [
    "mail a.b@c.de, x@y.z_q@e.fg and @no one@two", "é 10.0.0.255 1.2.3.4.5.6.7.8 256.1.1.1 000255.00.0.01 99999999999999999999.1.1.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 5500005555555559", "call +1 (437) 555-0689 or +49 30 123456 or +1 2",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not DE88370400440532013000",
    "my SSN 123-45-6789 and also 987-65-4321, 123-45-6780" + " " * 50 + "part 123-45-6789", "phone (415) 555-2671, order 415-555-2671", "\U0001f600 a@b.co", "a" * 20000 + "@", "1" * 20000, "1." * 9000, "+" * 5000 + "1 2 3",
    "a@b.co " * 700, "x@a" + ".b" * 4000,
    "call 555-123-4567 or 555-987-6543", "555-123-4567" + " far" * 12 + " 555-987-6543, 555-111-2222 is my phone",
]


def test_pii(spark, docs, texts, nothing):
    everything = [*texts, *PERSONAL]
    rows = {r.doc_id: r for r in pii.detect(spark.createDataFrame(clash(everything), SCHEMA)).collect()}
    for i, t in enumerate(everything):
        assert [(s.kind, s.start, s.end) for s in rows[i].base_spans] == brute_spans(t), t[:60]
        assert rows[i].spans[: len(rows[i].base_spans)] == rows[i].base_spans
    added = {i: [(s.kind, everything[i][s.start : s.end]) for s in r.spans[len(r.base_spans) :]] for i, r in rows.items()}
    k = len(texts)
    assert added[k + 4] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert added[k + 5] == [("ssn", "123-45-6789"), ("ssn", "123-45-6780")]
    assert added[k + 6][0] == ("local_phone", "(415) 555-2671")
    assert [x for _, x in added[k + len(PERSONAL) - 2]] == ["555-123-4567", "555-987-6543"]
    assert [x for _, x in added[k + len(PERSONAL) - 1]] == ["555-987-6543", "555-111-2222"]
    assert added[k + 3] == []
    assert pii.detect(nothing).count() == 0


def test_redact(spark):
    rows = pii.redact(spark.createDataFrame(clash([None, "", "no", *PERSONAL[:8]]), SCHEMA)).orderBy("doc_id").collect()
    assert [r.text for r in rows[:3]] == [None, "", "no"]
    assert rows[3].text == "mail <EMAIL>, <EMAIL><EMAIL> and @no one@two"
    assert rows[5].text == "card <CARD> or 4111-1111-1111-1112 and <CARD>"
    assert rows[6].text == "call <PHONE> or <PHONE> or +1 2"
    assert rows[7].text == "IBAN <IBAN> and <IBAN>, not DE88370400440532013000"
    assert rows[3].spans == "old"


def test_redaction_replaces_the_spans_that_are_detected(spark):
    rng = np.random.default_rng(8)
    parts = ["+49 10.20.30.40 55 66", "+14155552671 or 555-987-6543", "a@b.co", "4111 1111 1111 1111", "phone 555-987-6543", "é\U0001f600", "DE89 3704 0044 0532 0130 00", "ssn 123-45-6789", " ", "x", "+1 (437) 555-0689", "1.2.3.4"]
    texts = [*PERSONAL, *("".join(rng.choice(parts, size=int(n))) for n in rng.integers(1, 12, size=80)), "1.2.3.4 a@b.co " * 400]
    docs = spark.createDataFrame(clash(texts), SCHEMA)
    tags = {k.name: k.tag for k in pii.KINDS}
    spans = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    for r in pii.redact(docs).collect():
        want, end = "", 0
        for s in sorted(spans[r.doc_id], key=lambda s: (s.start, -s.end)):
            if s.start >= end:
                want += texts[r.doc_id][end : s.start] + tags[s.kind]
            end = max(end, s.end)
        assert r.text == want + texts[r.doc_id][end:]
    two = pii.redact(spark.createDataFrame(clash(parts[:2]), SCHEMA)).orderBy("doc_id").collect()
    assert [r.text for r in two] == ["<PHONE>", "<PHONE> or 555-987-6543"]


# ---------------------------------------------------------------- packing and tokens


def test_ids_equal_the_tokenizers_library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    encoder = Encoder(special=False)
    for t in [*filter(None, texts), "<|endoftext|> x", "́​  \t\r\n\n  a", "日本語 русский", " " * 300, "'s 'LL don't"]:
        assert encoder.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids == encoder.plain_ids(t).tolist()


@pytest.mark.parametrize("capacity", [16, 1024])
def test_pack(docs, texts, nothing, capacity):
    special = docs.sparkSession.createDataFrame([(len(texts), "a<|endoftext|>b", "en", 0.5, 7, "old")], SCHEMA)
    docs, texts = docs.union(special), [*texts, "a<|endoftext|>b"]
    rows = packing.pack(docs, capacity=capacity).collect()
    encoder = Encoder()
    assert 50256 in encoder.ids(texts[-1])
    ids = {i: np.append(encoder.ids(t or ""), 2).astype("<u4") for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and 0 < r.length <= capacity
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in ids.items():
        pieces = sorted(by_doc[i])
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == len(own)
        assert all(n == capacity for _, _, n in pieces[1:])
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= capacity
    assert packing.pack(nothing).count() == 0


def test_plan_uses_every_piece_and_few_sequences():
    rng = np.random.default_rng(2)
    for lengths, slack in ((rng.integers(1, 101, 5000), 1.01), (rng.integers(26, 50, 5000), 1.10), (np.full(7, 60), 1.7), (np.array([100, 1]), 2.0)):
        bins = packing.plan(Counter(lengths.tolist()), 100)
        used = Counter()
        for pattern, times in bins:
            assert sum(pattern) <= 100 and times > 0
            for x in pattern:
                used[x] += times
        assert used == Counter(lengths.tolist())
        assert sum(t for _, t in bins) <= np.ceil(lengths.sum() / 100) * slack
        for length, table in packing.places(bins).items():
            assert table[0, 0] == 0 and (np.diff(table[:, 0]) > 0).all(), length


@pytest.mark.parametrize("pool", [8192, 5])
def test_token_rows_are_lossless(docs, texts, nothing, pool):
    rows = tokenout.packed(docs, row=64, pool=pool).collect()
    encoder, parts = Encoder(special=False), {}
    for r in rows:
        ids, positions, ends = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2"), r.cu_seqlens
        assert len(ids) == 64 and ends[0] == 0 and ends[-1] == r.n_tokens and (ids[r.n_tokens :] == 50256).all()
        for doc, start, a, b in zip(r.doc_ids, r.starts, ends, ends[1:], strict=False):
            parts.setdefault(doc, {})[start] = ids[a:b]
            assert positions[a:b].tolist() == list(range(b - a))
    for i, t in enumerate(texts):
        joined = np.concatenate([parts[i][s] for s in sorted(parts[i])])
        assert joined.tolist() == [*encoder.ids(t or "").tolist(), 50256]
    assert tokenout.packed(nothing).count() == 0
    back = tokenout.documents(tokenout.write(docs, row=64)).collect()
    assert all(np.frombuffer(r.ids, "<u2").tolist() == parts[r.doc_id][r.start].tolist() for r in back if pool == 8192)


def test_best_fit_decreasing_is_the_textbook_one():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 51, 400)
    rows, rooms = tokenout.best_fit_decreasing(lengths, 50), []
    for size in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= size
        else:
            rooms.append(50 - size)
    assert sorted(50 - sum(lengths[r]) for r in rows) == sorted(rooms)


# ---------------------------------------------------------------- vectors


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 12))
    near = base[:30] + rng.normal(size=(30, 12)) * 0.12
    rows = [v.tolist() for v in np.vstack([base, near, base[:5], base[:5] * 3])]
    odd = [None, [], [0.0] * 12, [1.0, None] + [0.0] * 10, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1.0, 2.0], [2.0, 4.0], [1e300] * 12, [1e-300] * 12]
    table = spark.createDataFrame([(i, v, -1, True) for i, v in enumerate([*rows, *odd])], "vec_id long, embedding array<double>, n_links int, kept boolean")
    found = {r.vec_id: r for r in embeddings.near_duplicates(table, per_list=8, block=16, reach=50.0).collect()}
    sound = {i: np.array(v) / max(np.abs(v)) for i, v in enumerate([*rows, *odd]) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(i, j) for i, x in sound.items() for j, y in sound.items() if i < j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9]
    n = len(rows) + len(odd)
    count, root = Counter(k for pair in links for k in pair), union_find(n, links)
    for i in range(n):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (count[i], root[i], root[i] == i), i
    for more in ({"max_lists": 2}, {"per_list": 2, "block": 7, "codes": 4}):
        other = embeddings.near_duplicates(table, keep=["vec_id"], reach=50.0, **more).collect()
        assert {tuple(r) for r in other} == {(i, r.n_links, r.component_id, r.kept) for i, r in found.items()}
    assert embeddings.near_duplicates(table.limit(0)).count() == 0
    assert [r.n_links for r in embeddings.near_duplicates(table.where("embedding is null")).collect()] == [0]


def test_vectors_recall(spark):
    """Partners at cosine 0.9 in random directions, with the production margin."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(1500, 64))
    z -= (z * x[:1500]).sum(1, keepdims=True) * x[:1500]
    y = 0.902 * x[:1500] + np.sqrt(1 - 0.902**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(5500), "embedding": pa.array(np.vstack([x, y]).astype(np.float32).tolist(), pa.list_(pa.float32()))}))
    total = embeddings.near_duplicates(table, per_list=64).agg(F.sum("n_links")).first()[0]
    u = np.vstack([x, y]).astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = int((u @ u.T >= 0.9).sum()) - len(u)
    assert 0.95 * true <= total <= true


# ---------------------------------------------------------------- language and quality


def test_language(spark, docs, texts, nothing):
    words = {"en": "the and of house with", "de": "der und von Haus mit", "fr": "le et des maison avec", "ru": "и дом с на мир"}
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 30)), lang) for i, lang in enumerate(list(words) * 20)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled, switch=3.0)
    mixed = "the house and the house of the house, der Haus und von mit der Haus, дом и мир на"
    asked = spark.createDataFrame([(0, mixed), (1, None), (2, ""), (3, "12 !?"), (4, "дом"), (5, "le maison " * 5000)], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.identify(asked, model).collect()}
    assert [s.lang for s in found[0].spans] == ["en", "de", "ru"]
    assert mixed[found[0].spans[1].start : found[0].spans[1].end].startswith("der Haus")
    assert [found[i].lang_pred for i in range(6)] == ["en", "und", "und", "und", "ru", "fr"]
    assert found[1].score == 0.0 and found[4].score == 1.0 and found[1].spans == []
    every = langid.identify(docs, model, cells=64).collect()
    assert len(every) == len(texts) and all(0 <= r.score <= 1 and r.shard == 7 for r in every)
    kept = langid.identify(asked, model, only=model.languages, min_score=0.5)
    assert kept.columns == asked.columns and {r.doc_id for r in kept.collect()} == {r for r in (0, 4, 5) if found[r].score >= 0.5}
    blank = langid.fit(labelled.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, blank).collect()} == {"und"} and langid.identify(nothing, model).count() == 0


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(10)
    scores = rng.normal(size=(40, 3)).astype(np.float32)
    first, length = np.array([0, 7, 8, 20]), np.array([7, 1, 12, 20])
    labels = langid.viterbi(scores, first, length, 0.8)
    for a, n in zip(first, length, strict=True):
        best = np.full((n, 3), -np.inf)
        best[0] = scores[a]
        for t in range(1, n):
            for k in range(3):
                best[t, k] = scores[a + t, k] + max(best[t - 1, j] - 0.8 * (j != k) for j in range(3))
        path = labels[a : a + n]
        got = sum(scores[a + t, path[t]] for t in range(n)) - 0.8 * (np.diff(path) != 0).sum()
        assert got == pytest.approx(best[-1].max(), abs=1e-4)


def test_quality(spark, docs, texts, nothing):
    rng = np.random.default_rng(11)
    good = [" ".join(rng.choice(FILLER, 40)) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(FILLER, 40)) for _ in range(80)] + [" ".join(["same"] * 60)] * 40
    rows = [(i, t, int(i < 150)) for i, t in enumerate(good + bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    described = quality.describe(table, keep=["doc_id"])
    model = quality.fit(described.where("doc_id % 4 <> 1"), table.select("doc_id", "quality").union(table.where("doc_id = 3").select("doc_id", "quality")))
    found = {r.doc_id: r for r in quality.score(described, model).collect()}
    held = [i for i, _, _ in rows if i % 4 == 1]
    assert np.mean([found[i].predicted == rows[i][2] for i in held]) > 0.95
    every = quality.score(quality.describe(docs), model).collect()
    assert len(every) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.shard == 7 for r in every)
    assert quality.fit(described, table.select("doc_id", "quality").limit(0)) is None
    assert {r.score for r in quality.score(described, None).collect()} == {0.5}
    assert quality.score(quality.describe(nothing), model).count() == 0
    x, level = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4))
    assert level.tolist() == pytest.approx([0.1, 0.4, 0.9]) and x.tolist() == pytest.approx([1, 2.5, 4])


CLASHING = ["__text", "__id", "__body", "__task", "__mine", "__nth", "__rank", "__email", "__order", "__key", "keep_text", "keep_doc_id", "node", "fingerprint", "copies"]


def test_columns_of_any_name_go_through(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(["a b c", "a b c", None, "the end of it. a@b.co", "x " * 50])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in CLASHING})
    bench = spark.createDataFrame([(1, "the end of it")], "item_id long, text string")
    model = langid.fit(docs)
    made = {
        "decontaminate": decontam.decontaminate(docs, bench), "language": langid.identify(docs, model), "pii": pii.detect(docs), "redact": pii.redact(docs), "pack": packing.pack(docs),
        "simhash": simhash.near_duplicates(docs), "shingles": shingles.near_duplicates(docs), "shard": sharding.shard(docs, 2), "mix": mixing.plan(docs), "describe": quality.describe(docs),
    }
    replaced = {"simhash": {"fingerprint"}, "mix": {"copies"}}
    for name, found in made.items():
        rows = found.collect()
        assert {r.doc_id for r in rows} == set(range(5)), name
        for c in set(CLASHING) - replaced.get(name, set()):
            assert all(r[c] == f"{c}:{r.doc_id}" for r in rows), (name, c)
