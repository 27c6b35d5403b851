"""Each operator on awkward rows, on an empty table, and beside a brute-force version."""

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from agentlog.llm import bloom, exact, families, fingerprint, langid, linewindows, minhash, mixture, pieces, pii, sharding, urls
from agentlog.llm.components import components
from tests.llm.cases import documents, empty, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return empty(spark)


def texts(docs):
    return [r.text for r in docs.select("text").collect()]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bits = bloom.filter_bits(5000)
    other = spark.range(5000, 45_000).select(F.xxhash64("id").alias("k"))
    blocks = bloom.build(keys, "k", bits)
    assert bloom.mark(keys, "k", blocks, bits, "f").where("NOT f").isEmpty()
    assert bloom.mark(other, "k", blocks, bits, "f").where("f").count() < 1600
    twice = bloom.build(keys.union(keys.limit(100)), "k", bits, repeated=True)
    assert bloom.mark(keys.limit(100), "k", twice, bits, "f").where("NOT f").isEmpty()
    assert bloom.mark(keys, "k", twice, bits, "f").where("f").count() < 1500


def test_exact_groups(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    expected = Counter()
    for i, t in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        expected[i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact.duplicate_groups(docs).collect())) == expected
    # A filter of one block lets nearly everything through by chance; the result is the same.
    assert Counter(map(tuple, exact.duplicate_groups(docs, max_bits=bloom.BLOCK_BITS).collect())) == expected
    kept = exact.drop_duplicates(docs)
    assert kept.columns == docs.columns
    best = sorted(max((x for x in g if x is not None), default=None) for g in groups.values())
    assert sorted(r.doc_id for r in kept.collect()) == best
    assert exact.duplicate_groups(none).isEmpty() and exact.drop_duplicates(none).isEmpty()


def test_urls(spark):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]
    cases = [
        ("http://EXAMPLE.com/en/1?x#y", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("x://b.net/es/#://q", "b.net", "/es/", "net/es/", "block"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("https://www.listed.org/p/?utm_source=a", "www.listed.org", "/p/", None, "block"),
        ("http://listed.org/p?ref=1&k=2", "listed.org", "/p", None, "allow"),
        ("http://listed.com/p", "listed.com", "/p", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "clash", "clash") for i, c in enumerate(cases)], "page_id int, url string, host string, _url_key string")
    listed = spark.createDataFrame([("listed.org/p",), ("listed.com/p",), ("listed.org/p",), (None,)], "canonical string")
    out = urls.judge_urls(pages, listed, rules)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert out.columns.count("host") == 1 and "_url_key" in out.columns
    every = urls.judge_urls(pages.where("false"), listed.where("false"), rules)
    assert every.isEmpty()
    assert urls.judge_urls(pages, listed.where("false"), []).where("verdict = 'block'").isEmpty()
    twice = spark.createDataFrame([("http://www.a.org/x/",), ("https://a.org/x#f",), ("http://a.org/y",), (None,)], "url string")
    assert [r.canonical for r in urls.repeated_urls(twice).collect()] == ["a.org/x"]


def test_pieces_equal_the_library(spark, docs, none):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = pieces.encode(docs, MODEL)
    assert encoded.columns == [*docs.columns, "ids", "decoded"]
    for r in encoded.select("text", "ids", "decoded").collect():
        ids = lib.encode(r.text or "")
        assert r.ids == ids and r.decoded == lib.decode(ids)
    assert pieces.encode(none, MODEL).isEmpty()
    digest = encoded.where("doc_id = 3").select(*pieces.digests(encoded)).first()
    assert digest == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_codec_on_odd_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        codec = pieces.Codec(f.read())

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(" \u2581\n\t.,e tha"), st.characters(exclude_categories=["Cs"])), max_size=60))
    def same(text):
        raw, decoded = codec.encoded(text)
        ids = lib.encode(text)
        assert list(memoryview(raw).cast("i")) == ids
        assert decoded == lib.decode(ids) == codec.decode(ids)

    same()
    for text in (" " * 40, "a" * 5000, "日" * 300, " \n" * 50, "<s>" + "=" * 99):
        assert list(memoryview(codec.encoded(text)[0]).cast("i")) == lib.encode(text)


def test_codec_keeps_little_of_each_word():
    import tracemalloc

    with open(MODEL, "rb") as f:
        codec = pieces.Codec(f.read())
    text = " ".join(hashlib.sha256(b"%d" % i).hexdigest()[:8] for i in range(20_000))
    codec.encoded(text[: len(text) // 2])  # tests most pairs of pieces
    before = len(codec.words)
    tracemalloc.start()
    codec.encoded(text)
    grown = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert grown < 220 * (len(codec.words) - before)  # bytes
    assert len(codec.words) == 20_000


def test_pseudonyms(spark, docs):
    import re

    rows = [
        "bob.S-9@x.co.uk or bob.S-9@x.co.uk, eve@x", "4111 1111 1111 1111, 4111111111111111, 4111111111111112, 3782-822463-10005",
        "192.168.1.7. 10.0.0.300 1.2.3.4.5", "2024-02-29 31/12/1999 12/31/1999 05.06.2001 2023-02-30",
        "123-45-6789 666-12-3456", "+1 (626) 555-5759 +16265555759 626-555-5759 +1 (626) 555-5759 42.73.240.87",
        "x" * 50_000 + "@", "1" * 50_000, None, "", "clean text 2.0 and 17",
    ]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(rows)], "doc_id int, text string, pii string")
    out = pii.pseudonymise(df, "k").orderBy("doc_id").collect()
    new = [r.text for r in out]
    kinds = [[p.kind for p in r.pii] for r in out]
    assert kinds[:6] == [["email"] * 2, ["card"] * 3, ["ipv4"], ["date"] * 4, ["ssn"], ["phone"] * 4 + ["ipv4"]]
    assert new[6:] == rows[6:] and kinds[6:] == [[]] * 5
    mails = re.findall(r"[a-z]{3}\.[A-Z]-[0-9]@x\.co\.uk", new[0])
    assert len(mails) == 2 and mails[0] == mails[1] != "bob.S-9@x.co.uk" and new[0].endswith(", eve@x")
    cards = re.findall(r"[0-9][0-9 -]+[0-9]", new[1])
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and cards[2] == "4111111111111112"
    for c in (cards[0], cards[3]):
        digits = [int(x) for x in re.sub("[^0-9]", "", c)][::-1]
        assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert new[2].endswith(". 10.0.0.300 1.2.3.4.5") and all(int(x) < 256 for x in new[2].split(". ")[0].split("."))
    iso, a, b, point, bad = new[3].split(" ")
    assert bad == "2023-02-30" and a.split("/") == [b.split("/")[1], b.split("/")[0], b.split("/")[2]]
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", iso) and re.fullmatch(r"\d\d\.\d\d\.\d{4}", point)
    phones = [re.sub("[^0-9]", "", x)[-10:] for x in re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+\d{11}|\d{3}-\d{3}-\d{4}", new[5])]
    assert len(phones) == 4 and phones[0] == phones[1] == phones[3]
    assert {r.text for r in pii.pseudonymise(df, "other").where("doc_id < 6").collect()}.isdisjoint(new[:6])
    odd = pii.pseudonymise(docs, "k")
    assert Counter(texts(odd)) == Counter(texts(docs))
    assert pii.pseudonymise(df.where("false"), "k").isEmpty()


def test_permutations_are_permutations(spark):
    for n in (1, 2, 3, 10, 1000):
        df = spark.range(n).select("id", mixture.shuffled_index(F.col("id"), F.lit(n).cast("bigint"), "s").alias("p"))
        back = df.select("id", mixture.shuffled_index(F.col("p"), F.lit(n).cast("bigint"), "s", inverse=True).alias("b"))
        assert sorted(r.p for r in df.collect()) == list(range(n)) and back.where("id <> b").isEmpty()
    sizes = F.array(F.lit(7).cast("bigint"), F.lit(11).cast("bigint"), F.lit(3).cast("bigint"))
    cells = spark.range(231).select(F.array(F.col("id") % 7, F.floor(F.col("id") / 7) % 11, F.floor(F.col("id") / 77)).alias("v"))
    assert cells.select(pii.feistel(F.col("v"), sizes, "k", "t").alias("w")).distinct().count() == 231


def word_set(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def brute_components(rows, words, percent):
    """(doc_id, text) rows -> the smallest id of each row's component."""
    sets = [word_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(rows[i][0], len(sets[i]), least.get(find(i))) for i in range(len(rows))]


def test_near_duplicates(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(docs, words=3, percent=85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, 3, 85))
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 8, 10, 11, 12, 13}
    assert minhash.near_duplicates(none).isEmpty() and minhash.drop_near_duplicates(none).isEmpty()


def test_near_duplicates_in_chains_and_mixed_buckets(spark):
    """Chains of small changes, and families that share most of a template but aren't alike."""
    rows = []
    for family in range(12):
        template = prose(100, 46 + family % 2).split()
        own = prose(200 + family, 8).split()
        for step in range(12):
            text = template + own
            for k in range(step):
                text[(5 * k + family) % len(text)] = f"v{family}_{k}"
            rows.append((1000 - len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, words=3, percent=85).collect())
    expected = brute_components(rows, 3, 85)
    assert got == Counter(expected)
    assert 1 < len({e[2] for e in expected}) < len(rows)


def test_near_duplicates_go_by_row(spark):
    """A near copy goes alone, not with all rows that have its doc_id or none; rows that repeat leave one."""
    base = prose(500, 60).split(" ")
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (1, 57, 58)]
    rows = [(1, " ".join(base)), (2, near[0]), (2, prose(501, 60)), (None, near[1]), (None, prose(502, 60)), (None, ""), (None, None)]
    rows += [(4, prose(503, 60))] * 3 + [(None, prose(504, 60))] * 2 + [(6, near[2]), (6, None), (6, prose(505, 60))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, n int")
    kept = minhash.drop_near_duplicates(df).collect()
    expected = [rows[0], rows[2], rows[4], rows[5], rows[6], rows[7], rows[10], *rows[-2:]]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(expected)
    assert all(rows[r.n] == (r.doc_id, r.text) for r in kept)


def test_near_duplicates_of_repeated_rows_in_large_buckets(spark):
    """Rows repeat with their doc_id, or with none, inside a family of more than SMALL on one template."""
    template = prose(300, 90).split()
    texts = []
    for i in range(48):
        text = template + prose(400 + i // 2, 9).split()  # two by two they are alike
        texts.append(" ".join([*text[: 10 + i], f"own{i}", *text[11 + i :]]))
    rows = [(i if i % 3 else None, t) for i, t in enumerate(texts) for _ in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    sets = []
    whole = minhash._whole_sets
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(minhash, "_whole_sets", lambda *a: sets.append(whole(*a)) or sets[-1])
        got = minhash.near_duplicates(df, words=3, percent=88).collect()
    expected = brute_components(rows, 3, 88)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(expected)
    assert 2 < len({e[2] for e in expected}) < 40
    assert sets[0].count() == sets[0].select("rep").distinct().count() > 16


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (150, 300), (7, 7), (9, 8)] + [(500, x) for x in range(501, 540)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys([100, 150, 200, 300], 100), **dict.fromkeys(range(500, 540), 500)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def test_language(spark, docs, none):
    rows = []
    for i in range(240):
        lang, text = [("en", "the thing with that"), ("de", "der und nicht schön"), ("fr", "le être pour où"), ("es", "el niño año qué")][i % 4]
        rows.append((i, " ".join([text, prose(i, 3)]), lang))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("held", langid.is_held_out(F.col("doc_id")))
    model = langid.fit(df.where("NOT held"))
    out = langid.predict(df.where("held"), model)
    assert out.where("lang <> lang_pred OR score < 0 OR score > 1").isEmpty() and not out.isEmpty()
    import zlib

    assert {r.doc_id for r in df.where("held").collect()} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2}
    odd = {r.text: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert odd[None] == odd[""] == odd[" \n\t "] == ("und", 0.0) and odd["one"][0] in {"en", "de", "fr", "es"}
    assert langid.predict(none, model).isEmpty()
    unfitted = langid.fit(none)
    assert langid.predict(docs, unfitted).where("lang_pred <> 'und'").isEmpty()
    one = langid.fit(df.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.predict(docs.where("doc_id = 1"), one).collect()} == {"fr"}
    known = langid.with_known_language(docs, model)
    assert known.columns == docs.columns and known.count() == docs.count() - 3


def targets(sizes):
    """Water filling, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        rate = left / sum(weight[s] for s in free)
        full = {s for s in free if rate * weight[s] >= 2 * sizes[s]}
        for s in full or free:
            out[s] = 2.0 * sizes[s] if full else rate * weight[s]
        left -= sum(2.0 * sizes[s] for s in full)
        free = free - full if full else set()
    return out


def test_mix(spark, docs, none):
    many = spark.createDataFrame(
        [(i, prose(i, 1 + i % 90), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(400)], "doc_id bigint, text string, source string"
    )
    for df, block in ((docs, 512), (many, 64)):
        mix = mixture.plan_mix(df, block_words=block, shard_slots=16)
        rows = mixture.taken_words(mix).collect()
        words = {(r.doc_id, r.text, r.source): len((r.text or "").encode().split()) for r in df.select("doc_id", "text", "source").collect()}
        by_source = Counter()
        for (_, _, s), n in words.items():
            by_source[s] += n * (2 if (s, n) == (None, 1) else 1)
        expected = targets(by_source)
        taken = Counter()
        source = {r.row_id: r.source for r in mix["sizes"].collect()}
        for r in mix["pieces"].collect():
            taken[source[r.row_id]] += r.n_words * r.uses
        assert len(rows) == df.count() and all(r.taken <= 2 * r.size for r in rows)
        assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len((r.text or "").encode().split())) for r in df.collect())
        for s, t in expected.items():
            assert abs(taken[s] - t) <= 1
        for r in rows:
            assert abs(r.target - min(expected.values(), key=lambda t: abs(t - r.target))) < 1e-6
        slots = mix["slots"].collect()
        assert len({(r.shard, r.slot) for r in slots}) == len(slots)
        assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixture.taken_words(mixture.plan_mix(df, block_words=block)).collect()), key=repr)
        mixed = mixture.mixed_documents(df, block_words=block)
        assert mixed.columns == df.columns
        assert sum(len(t.encode().split()) for t in texts(mixed)) == sum(r.taken for r in rows)
    assert mixture.taken_words(mixture.plan_mix(none)).isEmpty() and mixture.mixed_documents(none).isEmpty()


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        lines, gone = (t or "").split("\n"), set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if any(x.encode().strip() for x in window):
                if window in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(window)
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_lines(spark, docs, none):
    import random

    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "long line"]) for _ in range(rng.randrange(30)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in linewindows.drop_repeated_lines(df).collect()} == brute_lines(rows)
    # A row that the filter lets through by chance has no places.
    chance = spark.createDataFrame([("a\nb", []), ("a\nb\nc\nd", [1])], "t string, p array<int>")
    cut = chance.select(linewindows._without()("t", "p").alias("r")).select("r.*").collect()
    assert [(r.text, r.removed) for r in cut] == [("a\nb", 0), ("a", 3)]
    out = linewindows.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "removed_lines"] and out.count() == docs.count()
    got = {r.doc_id: (r.text, r.removed_lines) for r in out.collect()}
    assert got[13] == ("other\nlast", 3) and got[12][1] == 0 and got[3] == (None, 0) and got[4] == ("", 0)
    assert linewindows.drop_repeated_lines(none).isEmpty()


def test_shards(spark, docs, none):
    for df, limit in ((docs, 200), (docs, 10**9), (spark.range(3000).selectExpr("id AS doc_id", "repeat('x', int(id % 50)) AS text"), 500)):
        out = sharding.shards(df, limit)
        rows = out.collect()
        assert len(rows) == df.count()
        total, ids = Counter(), defaultdict(set)
        for r in rows:
            total[r.shard] += len((r.text or "").encode())
            ids[r.shard].add((r.doc_id, r.text))
        assert all(total[s] <= limit or len(ids[s]) == 1 for s in total)
        assert all(r.shard_bytes == total[r.shard] for r in rows)
        # No shard's name begins another's, and a pair that would fit together was not split.
        assert not any(a != b and b.startswith(a) for a in total for b in total)
        assert not any(s and s[:-1] + "10"[int(s[-1])] in total and total[s] + total[s[:-1] + "10"[int(s[-1])]] <= limit for s in total)
    assert sharding.shards(none, 100).isEmpty()


def test_fingerprints(spark, docs, none):
    rows = [(i, prose(i, 150)) for i in range(60)] + [(100, prose(3, 150)), (101, None), (102, ""), (None, "first"), (103, "last one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for at, (i, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert out[i].n_chars == len(text) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        again = embed(edited)
        assert out[i].fingerprint == embed(text) and out[i].edited_fingerprint == again
        assert out[i].near_edited == fingerprint.likeness(embed(text), again)
        assert out[i].near_next == fingerprint.likeness(embed(text), embed(after))
    assert all(out[i].near_edited > 0.6 > 0.2 > out[i].near_next for i in range(50))
    close = {r.doc_id: r.alike_id for r in fingerprint.with_alike(fingerprint.fingerprints(df)).collect()}
    assert close[100] == 3 and close[5] == 5
    assert fingerprint.fingerprints(docs).count() == docs.count() and fingerprint.fingerprints(none).isEmpty()
    assert fingerprint.fingerprints(df.where("doc_id = 5")).first().edited_sha256


@pytest.mark.parametrize(("tile", "large"), [(fingerprint.TILE, fingerprint.LARGE), (8, 10**9), (8, 16)])
def test_fingerprints_of_a_template_family(spark, monkeypatch, tile, large):
    """Most of the family are unlike its smallest ids; copies and near copies further on are found all the same."""
    import random

    monkeypatch.setattr(fingerprint, "TILE", tile)
    monkeypatch.setattr(fingerprint, "LARGE", large)
    rng = random.Random(11)
    template = rng.randbytes(128)
    vary = lambda b, share: bytes(rng.randrange(256) if rng.random() < share else c for c in b)
    prints = {i: (2 + i % 2, vary(template[:: 1 + i % 2], 0.2)) for i in range(240)}
    for i in range(240, 320):
        scale, b = prints[rng.randrange(40, i)]
        coarser = scale == 2 and i % 4 == 0
        prints[i] = (3, vary(b[::2], 0.05)) if coarser else (scale, b if i % 2 else vary(b, 0.05)[: len(b) - i % 3])
    prints[500], prints[501] = prints[239], (3, vary(template[::2], 0.2))
    rows = [(i, f"{s:02x}{b.hex()}") for i, (s, b) in prints.items()]
    rows += [(501, rows[50][1]), (None, rows[60][1])]  # one id, two texts; and none
    df = spark.createDataFrame(rows, "doc_id bigint, fingerprint string")
    got = Counter((r.doc_id, r.fingerprint, r.alike_id) for r in fingerprint.with_alike(df).collect())
    ids = [r for r in rows if r[0] is not None]
    expected = [(d, f, min(e for e, g in ids if e <= d and (e == d or fingerprint.likeness(f, g) >= 0.8))) for d, f in ids]
    assert got == Counter([*expected, (*rows[-1], None)])
    assert sum(d != m for d, _, m in expected) >= 80


def embed(text):
    """The embedding step by step, from the same coins."""
    e = fingerprint.Embedder()
    codes = e.codes(text)
    j, steps = 0, []
    for k in e.kinds(codes).tolist():
        steps.append(j)
        j += (int(e.after[k + j % fingerprint.PERIOD]) - j - 1) % fingerprint.PERIOD + 1
    import numpy as np

    return e.sampled(codes, np.array([*steps, j]))


def test_fingerprint_survives_small_edits():
    text = prose(9, 400)
    words = text.split(" ")
    for at in (20, 150, 300):
        changed = " ".join([*words[:at], "inserted", *words[at + 1 :]])
        assert fingerprint.likeness(embed(text), embed(changed)) > 0.6
    assert fingerprint.likeness(embed(text), embed(prose(10, 400))) < 0.2
    assert fingerprint.likeness(embed(text), embed(text + " and a little more")) > 0.8


def template_texts(n, words=400, lacking=8, seed=1):
    """Texts that each lack some random words of one template: close to the limit of a likeness of 0.85."""
    import random

    rng = random.Random(seed)
    template = prose(700, words).split()
    return [" ".join(w for k, w in enumerate(template) if k not in gone) for gone in (set(rng.sample(range(words), lacking)) for _ in range(n))]


@pytest.mark.parametrize("block", [16, 4096])
def test_template_families_compare_few_pairs(spark, monkeypatch, block):
    """Members that no centre reaches are found by what they lack: all links, and far from all pairs."""
    monkeypatch.setattr(families, "BLOCK", block)
    compared = {}
    inner = families.verified
    for n in (200, 400):
        rows = list(enumerate(template_texts(n)))
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(families, "verified", lambda pairs, *a, n=n: compared.update({n: compared.get(n, 0) + pairs.count()}) or inner(pairs, *a))
            got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, words=3, percent=85).collect())
        expected = brute_components(rows, 3, 85)
        assert got == Counter(expected)
    # A row is compared with one centre per bucket at most; the rest is decided inside blocks.
    assert all(c <= 32 * n for n, c in compared.items()) and compared.get(400, 0) < 400 * 399 // 2 // 8


def test_overlap_is_exact_or_given_up():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 1 << 64, rng.integers(0, 40), np.uint64)) for _ in range(2))
        b = np.unique(np.r_[b, a[: len(a) // 2]])
        both = len(set(a.tolist()) & set(b.tolist()))
        assert families.overlap(a, b, 0) == both and families.overlap(a, b, both) == both
        assert families.overlap(a, b, both + 1) == -1
