"""Every operator against a plain version of it, on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegate.llm import line_dedup, ngram_join, token_counts
from tidegate.llm.bpe import decode, encode
from tidegate.llm.components import connected_components
from tidegate.llm.decontamination import contaminated
from tidegate.llm.hash_tree import Shard, assign_shards, layout, number_slots
from tidegate.llm.line_dedup import remove_near_lines
from tidegate.llm.near_vectors import near_vectors
from tidegate.llm.ngram_join import jaccard_components
from tidegate.llm.personal_data import KINDS, base_spans, personal_data
from tidegate.llm.queries import op3_toxicity
from tidegate.llm.repeats import repeated_only
from tidegate.llm.substring_dedup import remove_repeats

WORDS = r"[^\x20\x09-\x0D]+"


class Groups:
    """Connected groups by their smallest member."""

    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def of(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.of(a), self.of(b)
        self.up[max(a, b)] = min(a, b)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(docs):
    return dict(map(tuple, docs.collect()))


def noisy_copies(seed, number, words=60):
    """Texts of few words, many of them edited copies of others."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    found = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, words))) for _ in range(number // 3)]
    while len(found) < number:
        copy = rnd.choice(found).split()
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(copy))
            copy[at : at + rnd.randint(0, 1)] = rnd.choices(vocabulary, k=rnd.randint(0, 1))
            copy = copy or ["w0"]
        found.append(" ".join(copy))
    return found


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    links += [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    rnd.shuffle(links)
    groups = Groups({n for link in links for n in link})
    for a, b in links:
        groups.join(a, b)
    found = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    alone = {a for a, b in links if a == b} - {n for a, b in links if a != b for n in (a, b)}
    assert found == {n: groups.of(n) for n in groups.up if n not in alone}


def test_repeated_only_keeps_every_repeat(spark):
    rnd = random.Random(1)
    keys = [rnd.randrange(500) for _ in range(900)] + [7] * 400
    df = spark.createDataFrame(list(zip(keys, range(len(keys)))), "key long, id long").repartition(5)
    kept = {r.id for r in repeated_only(df, "key", ["id"]).collect()}
    often = {i for i, k in enumerate(keys) if keys.count(k) > 1}
    assert often <= kept and len(kept - often) <= 8


def test_bpe_is_that_of_the_library(spark, docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [
        "", "Hello  world's 123 don't <|endoftext|> x<|startoftext|>y", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ ß é",
        "a\x1cb \x85 c\xa0d", "日本語 한국어 😀👍🏽 \x00 ", "<|", "'s't're", "x" * 300 + " 1234567 !!!???", "à́ ́ b",
    ]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], docs.schema)
    known = texts | {10**6 + i: t for i, t in enumerate(odd)}
    found = decode(encode(docs.union(more), path), path).collect()
    library = Tokenizer.from_file(path)
    assert len(found) == len(known)
    assert sorted(found) == sorted(encode(docs.union(more), path, decoded=True).collect())
    for row in found:
        expected = library.encode(known[row.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == expected, known[row.doc_id][:80]
        assert row.n_tokens == len(expected)
        assert row.decoded == library.decode(expected, skip_special_tokens=False)


def test_token_counts_by_dynamic_programming(docs, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        model = token_counts.Pieces.of_file(file.read())

    def best(word):
        word = token_counts.START + word
        states = [(0, 0)]
        for i in range(1, len(word) + 1):
            size = len(word[i - 1].encode())
            options = [
                (states[j][0] + model.scores[word[j:i]], states[j][1] - 1)
                for j in range(i)
                if word[j:i] in model.scores
            ]
            if word[i - 1] not in model.scores:
                options.append((states[i - 1][0] + size * model.byte, states[i - 1][1] - size))
            states.append(max(options))
        return -states[-1][1], states[-1][0]

    for row in token_counts.token_counts(docs.limit(60), path).collect():
        counts = [best(w) for w in texts[row.doc_id].split()]
        assert row.n_words == len(counts)
        assert (row.n_tokens, row.score) == tuple(map(sum, zip(*counts)))
    assert dict(model.counted(["日本😀"]))["日本😀"] == best("日本😀")


def shingles(text, width=5):
    words = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or (
        {tuple(words)} if words else set()
    )


def test_jaccard_components(spark, texts):
    known = dict(texts) | {10_000 + i: t for i, t in enumerate(noisy_copies(5, 500))}
    sets = {i: shingles(t) for i, t in known.items()}
    meet = Counter()
    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            meet.update((j, i) for j in holders[s])
            holders[s].append(i)
    groups = Groups(sets)
    for (i, j), both in meet.items():
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            groups.join(i, j)
    df = spark.createDataFrame(list(known.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert found == {i: (len(s), groups.of(i)) for i, s in sets.items()}


def test_similar_sets_share_a_probed_key():
    similarity, rnd = Fraction(4, 5), np.random.default_rng(2)
    for size in [*range(1, 80)] * 12 + [500, 2000] * 3:
        x = np.unique(rnd.integers(0, 2**64 - 1, size, dtype=np.uint64))
        most = ngram_join.differences(size, size, similarity)
        gone = rnd.integers(0, most + 1)
        more = rnd.integers(0, 2**64 - 1, rnd.integers(0, most - gone + 1), dtype=np.uint64)
        y = np.unique(np.r_[rnd.permutation(x)[gone:], more])
        both = len(np.intersect1d(x, y))
        if not len(y) or 5 * both < 4 * (len(x) + len(y) - both):
            continue
        x, y = sorted((x, y), key=len)
        mine, needed = ngram_join.document_keys(x, similarity)
        theirs, _ = ngram_join.document_keys(y, similarity)
        at = 0 if len(x).bit_length() == len(y).bit_length() else 1
        exact, deleted = mine[2 * at], mine[2 * at + 1]
        # Whichever keys are the cheapest: any choice of as many as needed meets the other set.
        probe = rnd.permutation(exact)[: needed[at]]
        if needed[at] > len(exact):
            probe = np.r_[exact, deleted]
        assert needed[at] < 0 or len(np.intersect1d(probe, np.concatenate(theirs[:2])))


def test_repeated_passages_go(spark, texts):
    rnd = random.Random(4)
    known = dict(texts)
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(30):
        lead = " ".join(rnd.choices(["a", "b", "c d", "e"], k=rnd.randint(0, 40)))
        known[20_000 + i] = f"{lead} {passage if i % 3 else passage[: rnd.randint(90, 200)]}\t tail {i}"
    known[30_000] = "x y " * 100
    words = {i: re.findall(WORDS, t) for i, t in known.items()}
    count = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    df = spark.createDataFrame(list(known.items()), "doc_id long, text string")
    for row in remove_repeats(df).collect():
        own = words[row.doc_id]
        gone = set()
        for k in range(len(own) - 34):
            if count[tuple(own[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        assert (row.n_words, row.n_removed) == (len(own), len(gone))
        assert row.kept == " ".join(w for k, w in enumerate(own) if k not in gone)


def test_vectors(spark):
    rnd = np.random.default_rng(6)
    centres = rnd.standard_normal((40, 16))
    vectors = np.concatenate([c + rnd.standard_normal((12, 16)) * s for c, s in zip(centres, np.linspace(0, 0.6, 40))])
    vectors = vectors.astype(np.float32).astype(float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosines = unit @ unit.T
    same = (vectors[:, None] == vectors[None]).all(axis=2)
    linked = (cosines >= 0.95) | same
    groups = Groups(range(len(vectors)))
    for i, j in zip(*np.nonzero(linked)):
        groups.join(int(i), int(j))
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {r.vec_id: r for r in near_vectors(df, miss=1e-6, block=5).collect()}
    assert len(found) == len(rows)
    for i in range(len(vectors)):
        assert (found[i].n_links, found[i].component_id) == (linked[i].sum() - 1, groups.of(i))
        assert found[i].kept == (groups.of(i) == i)
    assert all((found[i].n_links, found[i].component_id) == (0, i) for i in range(1000, 1005))


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = dict(map(tuple, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect()))
    rows = op3_toxicity(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + (a == b) / 2 for y, a in held if y for z, b in held if not z]
    assert sum(pairs) / len(pairs) > 0.7


def test_new_shard_takes_rows_only_into_itself(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    for n in (39, 40, 41, 44):
        placed = assign_shards(assign_shards(df, "doc_id", layout(n)), "doc_id", layout(n + 1), "grown")
        moved = placed.filter("shard != grown").collect()
        if n >= 40:
            assert moved and {r.grown for r in moved} == {n}
    sizes = Counter(r.shard for r in assign_shards(df, "doc_id", layout(40)).collect())
    assert len(sizes) == 40 and max(sizes.values()) < 2 * 100


def test_a_changed_weight_moves_rows_within_its_subtree(spark):
    df = spark.range(3000)
    tree = [Shard(f"r{i // 4}", f"k{i // 2}", i) for i in range(12)]
    heavier = [Shard(x.region, x.rack, x.shard, 2.0 if x.shard == 0 else 1.0) for x in tree]
    rows = assign_shards(assign_shards(df, "id", tree), "id", heavier, "later").collect()
    region = {x.shard: x.region for x in tree}
    rack = {x.shard: x.rack for x in tree}
    for r in rows:
        if region[r.shard] != region[r.later]:
            assert region[r.later] == "r0"
        elif rack[r.shard] != rack[r.later]:
            assert rack[r.later] == "k0"
        elif r.shard != r.later:
            assert r.later == 0
    share = Counter(r.later for r in rows)[0] / len(rows)
    assert abs(share - 2 / 13) < 0.03


def test_slots_have_no_gaps(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS shard", "CAST(NULL AS STRING) AS bucket")
    found = defaultdict(list)
    for r in number_slots(df, "shard", ["id"], rows=50).collect():
        found[r.shard].append(r.slot)
    assert {s: sorted(v) for s, v in found.items()} == {s: list(range(len(v))) for s, v in found.items()}


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return row[-1]


def test_near_lines(spark):
    rnd = random.Random(8)
    long = [" ".join(rnd.choices([f"word{i}" for i in range(200)], k=60)) for _ in range(12)]
    lines = [" ".join(w for k, w in enumerate(x.split()) if k != at) for x in long for at in (5, 99, 20)]
    lines += noisy_copies(9, 60, 25) + ["", "  ", "--", "W1  w2, W3!", "w1 w2 w3"]
    known = {i: "\n".join(rnd.choices(lines, k=rnd.randint(1, 6))) for i in range(80)}

    def normal(line):
        return re.sub(r"[\s!-/:-@\[-`{-~]+", " ", line.lower()).strip(" ")

    distinct = sorted({normal(x) for t in known.values() for x in t.split("\n")} - {""})
    df = spark.createDataFrame([(x, w) for x in distinct for w in x.split(" ")], "line string, word string")
    hashed = df.selectExpr("line", "xxhash64(word) AS h", "length(word) AS weight").collect()
    bits = defaultdict(lambda: [0] * 64)
    number = Counter()
    for r in hashed:
        number[r.line] += r.weight
        for b in range(64):
            bits[r.line][b] += (r.h >> b & 1) * r.weight
    simhash = {x: sum((2 * n > number[x]) << b for b, n in enumerate(bits[x])) for x in distinct}
    groups = Groups(distinct)
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            near = (simhash[x] ^ simhash[y]).bit_count() <= line_dedup.DISTANCE
            if near and edit_distance(x, y) <= math.floor(0.1 * max(len(x), len(y)) + 1e-9):
                groups.join(x, y)
    assert len({groups.of(x) for x in distinct}) < len(distinct)
    seen, expected = set(), {}
    for i in sorted(known):
        kept = []
        for line in known[i].split("\n"):
            group = groups.of(normal(line)) if normal(line) else None
            if group is None or group not in seen:
                kept.append(line)
            seen.add(group)
        expected[i] = "\n".join(kept)
    rows = remove_near_lines(spark.createDataFrame(list(known.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == expected
    assert all(r.n_lines - r.n_removed == len(expected[r.doc_id].split("\n")) * (r.n_lines != r.n_removed) for r in rows)


def test_block_masks_find_all_near_hashes():
    for lines in (10, 10**6, 10**11):
        masks = line_dedup.block_masks(lines)
        rnd = random.Random(lines)
        for _ in range(200):
            flips = sum(1 << b for b in rnd.sample(range(64), 3))
            assert any(flips & m == 0 for m in masks)


QUESTION = "Alice buys 12 apples and 7 kg of rice in Berlin. Then Alice gives 12 apples to Bob for 3 hours."


@pytest.mark.parametrize(
    "text, found, verbatim",
    [
        (QUESTION, True, True),
        ("Some words first. " + QUESTION.upper() + " And after", True, True),
        ("x " + QUESTION.lower() + " y", True, True),
        (QUESTION.replace("Alice", "Carol").replace("12", "40").replace("kg", "lb"), True, False),
        ("Alice buys 1 apples and 2 kg of rice in Berlin. Then Carol gives 3 apples to Alice for 2 hours.", False, None),
        ("Alice buys 12 apples.", False, None),
        ("An ordinary text about apples and rice, in Berlin and elsewhere, for some hours.", False, None),
    ],
)
def test_contamination(spark, text, found, verbatim):
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, QUESTION), (2, "wholly other words stand here in this item")], "item_id long, text string")
    rows = contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(5, 1)] * found
    assert [r.verbatim for r in rows] == [verbatim] * found


def test_contamination_of_the_given_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = {
        (r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in plain(r.text)
    }
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    def fits(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == 1:
            return all(int(p) <= 255 for p in match.split("."))
        if kind == 2:
            checked = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
            return 13 <= len(digits) <= 19 and sum(c // 10 + c % 10 for c in checked) % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return [
        (kind, m.start(), m.end())
        for kind, pattern in enumerate(PATTERNS)
        for m in re.finditer(pattern, text)
        if fits(kind, m[0])
    ]


def test_fixed_patterns(texts):
    odd = [
        "a@b.c._x@d.e", "a@b@c.d", "@x.y a@@b.c", "1.2.3.4.5.6.7.8 1.2.3", "4111 1111 1111 1111-",
        "+1 (22) 333-4444) +12", "999.1.1.1 0001.0002.3.04", "4111111111111111 4111-1111-1111-1111",
        "++1 23456789", "日本a@b.cé +49 30 123456.", "1" * 5000, "a" * 5000 + "@",
    ]
    rnd = random.Random(2)
    odd += ["".join(rnd.choices("aZ1 2.9@+-()%_é4", k=60)) for _ in range(3000)]
    for text in [*odd, *texts.values()]:
        assert base_spans(text) == plain_spans(text), text


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"please send the bill to my phone +49 30 555{i:04d} tomorrow") for i in range(10)]
    rows += [(100, "please send the bill to my phone 030/5551234 tomorrow"), (101, "030/5551234 elsewhere")]
    rows += [(102, "in 2024 we had 4444 visitors"), (103, None)]
    found = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {i: [(KINDS[s.kind], rows_text[s.start : s.end]) for s in found[i].spans] for i, rows_text in rows if rows_text}
    assert spans[100] == spans[101] == [("phone", "030/5551234")]
    assert spans[102] == [] and not found[100].base
    assert all(len(found[i].base) == 1 for i in range(10)) and found[103].spans == []


def test_digests_of_personal_data(spark, texts, sf_dir):
    from tidegate.llm.queries import op10_personal_data

    for row in op10_personal_data(spark, sf_dir).collect():
        spans = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in plain_spans(texts[row.doc_id]))
        assert row.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
