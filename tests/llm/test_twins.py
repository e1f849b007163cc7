"""Plain versions of language ID and the quality classifier, and what the operators'
bounds, joins and written rows hold."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleworks.llm import components, decontam, langid, quality, tokenout
from candleworks.llm.common import join_each, mix64
from candleworks.llm.queries import op9_token_rows
from candleworks.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
FILLER = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = ["the", "and", "Straße", "über", "maison", "où", "casa", "niño"] + [f"w{i}" for i in range(60)]
    some = [" ".join(rng.choice(words, size=int(n))) for n in rng.integers(1, 120, size=40)]
    return [*some, None, "", "   \n\t ", some[0], some[0], "x" * 30_000, "!!! ??? 123", "a b İstanbul \U0001f600 tail", " ".join(rng.choice(words, size=9000))]


# ---------------------------------------------------------------- decontamination


def test_automaton_is_built_once_and_within_its_bound(spark, texts, monkeypatch):
    """One build for all tasks and batches; the bound holds for what it measures."""
    rng = np.random.default_rng(5)
    items = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, 5000, 200)).encode()) for i in range(100)]
    found = decontam.build(items, 13, 1 << 30)
    assert len(found.size) == 100 * 188 and found.machine.get_stats()["total_size"] <= 18_800 * 13 * decontam.NODE_BYTES
    with pytest.raises(ValueError, match="bytes in every task"):
        decontam.build(items, 13, 18_800 * 13 * decontam.NODE_BYTES - 1)
    builds, build = [], decontam.build
    monkeypatch.setattr(decontam, "build", lambda *a: builds.append(a) or build(*a))
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(FILLER)])), "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame([(1, " ".join(FILLER))], "item_id long, text string")
    assert decontam.decontaminate(docs, bench).where("n_hit > 0").count() == 1 and len(builds) == 1


# ---------------------------------------------------------------- token rows


def test_ids_with_and_without_special_tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["<|endoftext|> x", "a<|endoftext|><|endoftext|>", "x <|endoftext|>\n y<|endoftext", "", "日本語 русский"]
    for special in (True, False):
        plain.encode_special_tokens = not special
        encoder = Encoder(special=special)
        for t in [*filter(None, texts), *odd]:
            assert encoder.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    assert 50256 in Encoder().ids(odd[0]) and 50256 not in Encoder(special=False).ids(odd[0])
    with pytest.raises(TypeError):
        Encoder().ordinary_ids(7)


def test_token_rows_of_other_widths_and_ids(spark, texts):
    named = spark.createDataFrame([(None if i == 3 else f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    back = tokenout.documents(tokenout.write(named, row=64, width=4), width=4).collect()
    assert {r.doc_id for r in back} == {None if i == 3 else f"d{i}" for i in range(len(texts))}
    encoder = Encoder(special=False)
    for r in back:
        ids = np.append(encoder.ids(texts[3 if r.doc_id is None else int(r.doc_id[1:])] or ""), 50256)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.end - r.offset].tolist()
    with pytest.raises(ValueError, match="more than 2 bytes"):
        tokenout.packed(named, end_id=70_000)


def test_token_query_shows_rows_places_and_resets(spark):
    """Every column of op9_token_rows against the texts and against its own rows."""
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_token_rows(spark, SF).collect()
    encoder, by_doc, by_row = Encoder(special=False), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_row.setdefault(r.row_id, []).append(r)
    for doc, own in text.items():
        ids, at = np.append(encoder.ids(own or ""), 50256).astype("<u2"), 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_row.values():
        own.sort(key=lambda r: r.segment)
        assert [r.segment for r in own] == list(range(len(own))) and own[-1].end == own[0].n_tokens <= 2048
        assert [r.offset for r in own] == [0, *[r.end for r in own[:-1]]] and all(r.end - r.offset == r.length for r in own)
        assert all(r.positions_crc32 == zlib.crc32(np.arange(r.length, dtype="<u2").tobytes()) for r in own)
    assert len(by_row) <= 1.02 * sum(r.length for r in rows) / 2048 + 8


# ---------------------------------------------------------------- joins and components


def test_components_of_a_hub(spark):
    """100,000 links to one node, with hubs broadcast and without."""
    star = spark.range(1, 100_001).select(F.lit(100_001).cast("long").alias("a"), F.col("id").alias("b"))
    star = star.union(spark.range(1).select((F.col("id") + 100_002).alias("a"), F.lit(50_000).cast("long").alias("b")))
    for hub in (1000, 10**9):
        found = components.components(star, hub=hub)
        assert found.count() == 100_002 and {r.root for r in found.select("root").distinct().collect()} == {1}


def test_join_each_keeps_every_row(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2, 3, 3, None])], "k int, i int")
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m"))
    for most in (2, 1000):
        found = join_each(left, right, "k", "n", 54, most)
        assert found.columns == ["k", "i", "m"] and sorted(r.i for r in found.collect()) == list(range(53))


# ---------------------------------------------------------------- language


@pytest.fixture(scope="module")
def labelled(spark):
    words = {"en": "the And of house".split(), "de": "der und Haus große".split(), "ru": "и дом Мир".split()}
    rng = np.random.default_rng(12)
    return words, [(i, " ".join(rng.choice(words[k], 12)) + ", 7!", k) for i, k in enumerate(list(words) * 6)]


def test_letters_of_all_planes_and_marks_alone(spark, labelled):
    model = langid.fit(spark.createDataFrame(labelled[1], "doc_id long, text string, lang string"), switch=2.0)
    odd = ["\U00030000\U00030001", "́̂ ́", "12 ́ дом́", "\U000e0100", "́" * 40_000 + " the of"]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()}
    assert found[0].lang_pred != "und" and found[0].spans[0].end == 2
    assert [found[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "ru", "und", "en"]
    assert found[1].score == 0.0 and found[3].spans == [] and found[2].spans[0].start == 5


def test_labels_of_many_languages():
    """More languages than a byte, or two, can number."""
    for n in (127, 128, 200, 40_000):
        scores = np.zeros((3, n), dtype=np.float32)
        scores[:, n - 1] = 5
        assert langid.viterbi(scores, np.array([0]), np.array([3]), 1.0).tolist() == [n - 1] * 3


def test_two_hundred_languages(spark):
    rows = [(i, f"{chr(0x4E00 + i % 200) * 3} " * 8, f"l{i % 200:03}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert all(r.lang_pred == r.lang for r in found)


def test_language_equals_a_plain_version(spark, labelled):
    """Counts, word scores, scripts, Viterbi and scores in plain Python on small texts."""
    words, rows = labelled
    asked = [r[1] for r in rows[:6]] + ["the Haus дом", "unknown zzz", "house, дом и мир! der und", "Ωmega the", ""]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), switch=2.0)
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    mix = lambda x: int(mix64(np.array([x % (1 << 64)], dtype=np.uint64))[0])

    def parts(text):
        """(start, end, script, buckets) of the words of a text."""
        for m in re.finditer(r"[^\W\d_]+", text):
            low = [ord(c.lower()) for c in m.group()]
            grams = [mix(((a * 0x110000) + b) * 0x110000 + c) for a, b, c in zip([0, *low], low, [*low[1:], 0], strict=False)]
            script = next(s for a, s in reversed(langid.SCRIPT_RANGES) if a <= ord(m.group()[0]))
            yield m.start(), m.end(), script, [g % langid.TRIGRAMS for g in grams], langid.TRIGRAMS + mix(sum(grams) + len(low)) % langid.WORDS

    names, grams, whole, letters = sorted(words), {}, {}, {}
    for _, text, k in rows:
        for a, b, script, own, word in parts(text):
            letters.setdefault(k, Counter())[script] += b - a
            grams.setdefault(k, Counter()).update(own)
            whole.setdefault(k, Counter())[word] += 1
    p = lambda table, k, x, n: math.log((table[k][x] + 0.1) / (sum(table[k].values()) + 0.1 * n))
    used = lambda k, script: letters[k][script] >= 0.001 * sum(letters[k].values())
    for i, text in enumerate(asked):
        best, back, spans = None, [], list(parts(text))
        for _, _, script, own, word in spans:
            score = [sum(p(grams, k, g, langid.TRIGRAMS) for g in own) + p(whole, k, word, langid.WORDS) for k in names]
            free = not any(used(k, script) for k in names)
            score = [s - max(score) if free or used(k, script) else -1e4 for s, k in zip(score, names, strict=True)]
            if best is None:
                best = score
                continue
            step = [max((best[j] - 2.0 * (j != k), j == k, -j) for j in range(3)) for k in range(3)]
            back.append([k if s[1] else -s[2] for k, s in enumerate(step)])
            best = [s[0] + x for s, x in zip(step, score, strict=True)]
        path = [max(range(3), key=lambda k: (best[k], -k))] if spans else []
        for links in reversed(back):
            path.insert(0, links[path[0]])
        mass = Counter()
        for (a, b, *_), k in zip(spans, path, strict=True):
            mass[k] += b - a
        want = max(range(3), key=lambda k: (mass[k], -k)) if spans else None
        assert found[i].lang_pred == (names[want] if spans else "und"), text
        assert found[i].score == pytest.approx(mass[want] / sum(mass.values()) if spans else 0.0, abs=1e-9)


# ---------------------------------------------------------------- quality


def plain_statistics(text):
    """The statistics of quality.STATISTICS, from their names, over bytes."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", raw) if w]
    lines = [x for x in re.split(rb"[\r\n]", raw) if x]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    ends = b",.'\":;?()-"
    symbol = lambda c: 33 <= c <= 126 and not chr(c).isalnum() and c not in ends
    over = lambda a, b: a / max(b, 1)
    plain_capitals = sum(65 <= c <= 90 for c in raw)
    capitals = plain_capitals + sum(a == 0xC3 and 0x80 <= b <= 0x9E for a, b in zip(raw, raw[1:], strict=False))
    letters = plain_capitals + sum(97 <= c <= 122 for c in raw) + sum(c >= 128 for c in raw)
    n, size, total = len(words), len(raw), sum(map(len, words))
    return [
        np.log1p(n), over(total, n), np.log1p(max(map(len, words), default=0)), over(capitals, letters), over(sum(48 <= c <= 57 for c in raw), size),
        over(sum(map(symbol, raw)), size), over(sum(c in ends for c in raw), size), over(sum(symbol(w[-1]) for w in words), n), over(len(set(low)), n),
        over(sum(a == b for a, b in zip(low, low[1:], strict=False)), n), over(max(Counter(low).values(), default=0), n),
        over(sum(len(w) <= 3 for w in words), n), over(sum(len(w) == 1 and symbol(w[0]) for w in words), n),
        over(len(lines), n), 1 - len(set(lines)) / len(lines) if lines else 0.0, over(sum(c >= 128 for c in raw), size), over(raw.count(b"!"), max(n, total / 50)),
    ]


def test_quality_equals_a_plain_version(spark, texts):
    """Statistics, features, ridge and isotonic levels against dense plain ones."""
    own = [*texts, "Ünïcode ÀÉ À!", "a\r\nb\n\na", "| | x |", "no. no. NO!"]
    mark = {i: i % 3 == 0 or i % 7 == 1 for i in range(len(own)) if i % 5}
    table = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(own)], "doc_id long, text string, statistics string").repartition(5)
    described = quality.describe(table)
    x = np.array([plain_statistics(t) for t in own])
    got = {r.doc_id: r[quality.DESCRIBED] for r in described.collect()}
    for i in range(len(own)):
        assert got[i] == pytest.approx(x[i].tolist(), abs=1e-9), own[i]
    labels = spark.createDataFrame([(i, int(v)) for i, v in mark.items()] + [(0, 5), (10, None)], "doc_id long, quality int")
    model = quality.fit(described, labels, features=20)
    ids = sorted(mark)
    mean, scale = x[ids].mean(0), x[ids].std(0)
    z = np.clip((x - mean) / np.where(scale > 1e-9, scale, 1.0), -8, 8)
    phi = np.column_stack([np.cos(z @ model.directions + model.phases) * np.sqrt(2 / 20), np.ones(len(x))])
    y = np.array([mark[i] for i in ids], dtype=float)
    weights = np.linalg.solve(phi[ids].T @ phi[ids] + 1e-3 * len(ids) / 21 * np.eye(21), phi[ids].T @ y)
    assert model.weights == pytest.approx(weights, rel=1e-6, abs=1e-7)
    raw = np.round(np.clip(phi[ids] @ model.weights, -1, 2) / quality.GRID).astype(int)
    cells = sorted(set(raw.tolist()))
    level, count = [y[raw == c].mean() for c in cells], [(raw == c).sum() for c in cells]
    mean_of = lambda a, b: np.average(level[a : b + 1], weights=count[a : b + 1])
    best = [max(min(mean_of(a, b) for b in range(k, len(cells))) for a in range(k + 1)) for k in range(len(cells))]
    assert sorted({round(v, 9) for v in best}) == pytest.approx(sorted({round(v, 9) for v in model.levels}))
    want = np.clip(np.interp(phi @ model.weights, model.knots, model.levels), 0, 1)
    for r in quality.score(described, model).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-9) and r.text == own[r.doc_id] and r.statistics == "mine"


def test_merges_go_by_a_tree(spark, monkeypatch):
    monkeypatch.setattr(quality, "MERGED", 2)
    table = spark.createDataFrame([(i, f"some text {i} " * (i % 9 + 1), i % 2) for i in range(60)], "doc_id long, text string, quality int").repartition(11)
    described = quality.describe(table, keep=["doc_id"])
    many = quality.fit(described, table, features=8)
    monkeypatch.setattr(quality, "MERGED", 10**6)
    assert many.weights == pytest.approx(quality.fit(described, table, features=8).weights, rel=1e-6)
