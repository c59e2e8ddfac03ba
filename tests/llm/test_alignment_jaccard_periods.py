"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwright.llm import alignment, jaccard, packing, periods, queries
from tests.conftest import DATA
from tests.llm.test_operators import ROWS, WORD, bag, docs, none  # noqa: F401

WIDE = {"runs": "r", "best": "b", "groups": "g", "pairs": 1, "row": 2, "name": "n", "block": 3, "shingle": 4}


@pytest.fixture(scope="module")
def clashing(docs):  # noqa: F811
    """The small table with columns named as the operators name theirs."""
    return docs.select("*", *[F.lit(v).alias(k) for k, v in WIDE.items()])


def sample(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]


# 11 -------------------------------------------------------------------------------------------
@lru_cache(maxsize=1)
def _tokenizers():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, {i: p for p, i in a.get_vocab().items()}, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _aligned(text):
    """Ids, groups and links of one text by plain walks over byte ranges."""
    if not text:
        return [], [], [], []
    a, names, b = _tokenizers()
    letters = packing._letters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts_a = [bytes(letters[c] for c in names[i]) for i in ids_a]
    parts_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode() for i in ids_b]
    if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b = np.cumsum([*map(len, parts_a)]).tolist(), np.cumsum([*map(len, parts_b)]).tolist()
    links, j = [], 0
    for i, (e, p) in enumerate(zip(ends_a, parts_a)):
        while ends_b[j] <= e - len(p):
            j += 1
        k = j
        while k < len(ids_b) and ends_b[k] - len(parts_b[k]) < e:
            links.append((ids_a[i], ids_b[k]))
            k += 1
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return ids_a, ids_b, groups, links


def _alignment(rows):
    found = [(i, _aligned(t)) for i, t in rows]
    counts = Counter(x for _, (*_, links) in found for x in links)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    for i, (a, b, groups, links) in found:
        spelled = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        sha = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        yield i, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha


ODD = [None, "", " ", "  x y ", "▁x", "a▁", "<s> </s> <|endoftext|> <0x41> <unk>", "\x00a\x00", "日本語 é\n\n\t x", "a" * 5000, "  " * 300, "🙂🙂 ﬁ"]


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 50, 0])
def test_alignment_equals_brute_force(spark, clashing, hot):
    """Whatever share of the pairs is looked up in place, the others are joined."""
    rows = ROWS + [(1000 + i, t) for i, t in enumerate(ODD)]
    more = spark.createDataFrame([r for r in rows if r[0] is None or r[0] >= 1000], "doc_id long, text string")
    got = alignment.alignment_digests(clashing.where("doc_id is not null").unionByName(more, True), hot).collect()
    assert bag(got) == bag(_alignment(rows))


def test_alignment_of_whole_table(spark):
    got = queries.queries()["op11_alignment"](spark, f"{DATA}/sf0.001").collect()
    assert bag(got) == bag(_alignment(sample(spark)))


def test_alignment_keeps_columns_and_takes_empty_tables(clashing, none):  # noqa: F811
    out = alignment.align(clashing, keep=("doc_id", "pairs", "n"))
    assert out.columns == ["doc_id", "n", *alignment.OUTPUT] and out.schema["pairs"].dataType.typeName() == "array"
    assert alignment.alignment_digests(none).collect() == []


def test_components_of_links_are_the_smallest_groups():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        u, v = rng.integers(0, n, (2, int(rng.integers(0, 40))))
        want = list(range(n))
        for _ in range(n):
            for a, b in zip(u, v):
                want[a] = want[b] = min(want[a], want[b])
        assert alignment.united(n, u, v).tolist() == want


# 12 -------------------------------------------------------------------------------------------
def _set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([" ".join(words)] if words else [])


def _components(rows):
    sets = [_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= 80 * len(s | sets[j]):
                parent[root(i)] = root(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def _near_copies():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    texts = []
    for _ in range(40):
        base = some(rng.choice([5, 6, 9, 20, 60, 200, 500]))
        for _ in range(rng.choice([1, 2, 3, 40])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append("  ".join(words) if rng.random() < 0.8 else " ".join(words).upper())
    passage = some(80)  # many share it, few of them link
    texts += [" ".join(passage + some(rng.choice([15, 18, 20, 22, 40]))) for _ in range(150)]
    chain = some(100)  # neighbours link, the ends do not
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 40, 3)]
    texts += [None, "", " \n", "a", "a b", "A B ", "a b c d", "a b c d e", "x " * 100, "x " * 5]
    rows = [(5000 - i, t) for i, t in enumerate(texts)]
    return rows + [(None, "a b"), rows[3], (7, rows[3][1])]


@pytest.mark.parametrize("limits", [{}, {"block_sets": 16, "leaders": 2}, {"block_sets": 64, "block_shingles": 4000, "leaders": 4}])
def test_jaccard_components_equal_brute_force(spark, limits):
    """The same where blocks are cut into cells."""
    rows = _near_copies()
    got = jaccard.set_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **limits).collect()
    assert bag(got) == bag(_components(rows))


def test_jaccard_of_whole_table_and_odd_rows(spark, clashing, none):  # noqa: F811
    got = queries.queries()["op12_jaccard"](spark, f"{DATA}/sf0.001").collect()
    assert bag(got) == bag(_components(sample(spark)))
    assert bag(jaccard.set_components(clashing).collect()) == bag(_components(ROWS))
    assert jaccard.set_components(none).collect() == []


def test_similarity_of_exactly_four_fifths_links():
    s = np.arange(9, dtype=np.uint64)
    assert jaccard.linked(9, s, 9, np.append(s[:8], np.uint64(99)))  # 8 of 10
    assert not jaccard.linked(9, s, 10, np.append(s[:8], np.array([98, 99], np.uint64)))  # 8 of 11
    assert jaccard.linked(8, s[:8], 10, np.append(s[:8], np.array([98, 99], np.uint64))) and not jaccard.linked(7, s[:7], 9, s)


# 13 -------------------------------------------------------------------------------------------
def _runs(words):
    """Runs by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stop = j + q
            if stop - i >= max(24, 3 * q) and not any(words[i : stop - r] == words[i + r : stop] for r in range(1, q)):
                out.append((i, stop - i, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _digests(rows):
    for d, t in rows:
        words = WORD.findall(t or "")
        h, n = zlib.crc32(str(d).encode()), len(words)
        if d is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = _runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        yield d, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        kinds, words = rng.choice([1, 2, 2, 3, 5]), []
        while len(words) < 100:
            unit = [rng.randrange(kinds) for _ in range(rng.randint(1, 12))]
            words += (unit * rng.randint(1, 9))[: rng.randint(1, 80)] + [rng.randrange(100) for _ in range(rng.choice([0, 0, 3]))]
        assert periods.runs_of(words) == _runs(words)


def test_automaton_gives_every_run_without_the_gram_filter():
    rng = random.Random(2)
    for _ in range(100):
        words = [rng.randrange(2) for _ in range(60)] + [0, 1, 1] * 12 + [rng.randrange(3) for _ in range(40)]
        assert sorted(periods.runs_of_stretch(words), key=lambda r: (r[0], r[2])) == _runs(words) == periods.runs_of(words)


def test_period_digests_equal_brute_force(spark, clashing, none):  # noqa: F811
    got = queries.queries()["op13_periods"](spark, f"{DATA}/sf0.001").collect()
    rows = [r for r in sample(spark) if len(r[1] or "") < 6000]
    ids = {r[0] for r in rows}
    assert bag(r for r in got if r[0] in ids) == bag(_digests(rows)) and len(got) == len(sample(spark))
    short = [r for r in ROWS if len(r[1] or "") < 20000]
    assert bag(r for r in periods.run_digests(clashing).collect() if r[0] not in (6, 7)) == bag(r for r in _digests(short) if r[0] not in (6, 7))
    assert periods.run_digests(none).collect() == []


def test_runs_keep_columns_and_texts(clashing):
    out = periods.periodic_runs(clashing.where("doc_id = 40"), ["doc_id", "runs", "rank"])
    assert out.columns == ["doc_id", "rank", *periods.OUTPUT]


def test_long_periodic_texts_take_seconds():
    for words in (["x"] * 100_000, [str(i % 7000) for i in range(60_000)], ["a", "b"] * 30_000):
        assert len(periods.runs_of(words)) == 1
