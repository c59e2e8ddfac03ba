"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwright.llm import decontam, html_text, licenses, packing, quality, queries, repeats, sharding, simhash, token_counts, toxicity
from tests.compare import connect, same
from tests.conftest import DATA

WORD = re.compile("[^\x20\x09-\x0d]+")


def _rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ñß語1") for _ in range(rng.randint(1, 7))).strip() or "x"
    long = " ".join(word() for _ in range(6000))
    base = [" ".join(word() for _ in range(rng.randint(60, 200))) for _ in range(25)]
    passage = " ".join(word() for _ in range(120))
    texts = [None, "", "  \n\t ", "one", "one two", "a\n\na\nb\n a", long, long, "ab" * 700, "x" * 5000, "é" * 401]
    texts += base + base[:5] + [base[6] + " " + passage, passage + base[7], base[8][:300] + passage + base[8][300:]]
    texts += [b.replace(" ", "  ", 1).upper() for b in base[10:13]] + [base[14] + " tail"] * 3 + ["### $$$ *** " * 30, "same line\n" * 40]
    return [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(8, "ab" * 700), (20, texts[20])]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    """Small table with nulls, ties, repeated rows and columns whose names operators use inside."""
    rows = [(i, t, f"h{k % 3}" if k % 7 else None, k, "z", 1) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, key string, rank int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_every_query_is_registered_once():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    d = f"{DATA}/sf0.001"
    assert same(spark, connect(d), queries.queries()[name], queries.oracle_sql()[name], d) == ""


# 1 --------------------------------------------------------------------------------------------
def test_token_counts_equal_the_tokenizer(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer, models

    pieces = token_counts.zipf_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    tok = Tokenizer(models.Unigram(pieces, [p for p, _ in pieces].index("<unk>"), True))

    def brute(text):
        marked = (text or "").replace(" ", "▁")
        if marked and not marked.startswith("▁"):
            marked = "▁" + marked
        return len(tok.encode(marked, add_special_tokens=False).ids)  # the whole text, unsplit

    counting = token_counts.Counting(pieces)
    for t in ("x    y", "    indented", " ", "     ", "a \n  b", "語  ▁▁ x", "\t  " * 40, "word" * 300 + "  end", "  é\u0301  " * 20):
        assert counting.text(t)[0] == brute(t), t
    assert not counting.whole and token_counts.Counting(pieces + [("a▁b", -1.0)]).whole
    got = token_counts.token_counts(docs).select("doc_id", "n_tokens").collect()
    assert bag(got) == bag((i, brute(t)) for i, t in ROWS)
    assert token_counts.token_counts(none).count() == 0


# 2 --------------------------------------------------------------------------------------------
def figures(text):
    ws, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    wins = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {i + k for i, w in enumerate(zip(ws, ws[1:], ws[2:])) if wins[w] > 1 for k in range(3)}
    out = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
    return *out, out[0] < 50 or 100 * out[4] > 50 * out[0]


def test_quality_figures_and_verdicts(docs, none):
    got = quality.quality_rules(docs)
    assert {"n", "key", "rank"} <= set(got.columns)
    rows = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert bag(rows) == bag((i, *figures(t)) for i, t in ROWS)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert bag(kept.select("n").collect()) == bag(got.where("kept").select("n").collect())
    assert quality.quality_rules(none).count() == 0 == quality.keep_good(none).count()


def test_a_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "short", "bad") for i in range(60)] + [(100 + i, f"{good} {i}", f"ok{i % 4}") for i in range(60)] + [(999, good, "bad")]
    got = {r.doc_id for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert got == set(range(100, 160))


# 3 --------------------------------------------------------------------------------------------
def test_each_template_has_a_gate_word():
    for ts in licenses.TEMPLATES.values():
        for t in ts:
            assert any(g in t.lower() for g in licenses.GATES) or "rights reserved" in t.lower()


def test_licences_are_named_and_mentions_are_not(spark, docs, none):
    model = licenses.train(docs)
    rows = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts[:1]]
    table = spark.createDataFrame([(i, f"Intro.\n{t}\nEnd.") for i, (_, t) in enumerate(rows)] + [(900, "The driver license office opens late."), (901, None), (902, "")], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.licences(table, model).collect()}
    right = sum(got[i] == f for i, (f, _) in enumerate(rows))
    assert right >= len(rows) - 1, [(f, got[i]) for i, (f, _) in enumerate(rows) if got[i] != f]
    assert (got[900], got[901], got[902]) == ("unknown", "none", "none")
    assert licenses.licences(none, model).count() == 0


def test_no_confirmable_paragraph_is_left_unscored():
    for t in (t for ts in licenses.TEMPLATES.values() for t in ts):
        grams = licenses.shape(t)
        ungated = [g for g in grams if not any(x in w for w in g.split() for x in licenses.SCORED)]
        assert len(ungated) / len(grams) < licenses.CONFIRM
        assert [p for _, p in licenses.paragraphs(t)] == [t]


def test_every_licence_form_of_the_tables(spark):
    """The five forms planted in the tables, on every line of sf0.1 that holds one, and notices with names in them."""
    forms = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache"}
    d = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    model = licenses.train(d)
    want = Counter(f for r in d.select("text").collect() for x in (r.text or "").split("\n") if (f := forms.get(x.strip())))
    got = Counter(x.family for r in licenses.scan(d, model).collect() for x in r.found if x.family != licenses.UNKNOWN)
    assert got == want and sum(want.values()) == 328
    for t in ("Copyright (c) 2020 Acme. All rights reserved.", "All rights reserved", "ALL RIGHTS RESERVED."):
        assert model.predict([p for _, p in licenses.paragraphs(t)])[0][0] == "proprietary"


def test_wrapped_licences_and_all_families_are_found(spark, docs):
    model = licenses.train(docs)
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "Redistribution and use in source and binary forms,\nwith or without modification, are permitted\nprovided that the following conditions are met:"
    texts = [f"Intro.\n\n{grant}\n\nEnd.", f"Intro.\n{bsd}\nEnd.\n\nLicensed under CC BY 4.0.\nLicensed under the\nApache License, Version 2.0.", "Licensed under the\n\nMIT License.", "Released under the MIT License."]
    rows = licenses.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [[(x.family, x.paragraph) for x in r.confirmed] for r in rows] == [[("mit", 2)], [("bsd", 1), ("cc-by", 6), ("apache", 7)], [], [("mit", 0)]]
    assert [r.n_confirmed for r in rows] == [1, 3, 0, 1]


def test_unknown_licence_lines_after_the_first_are_trained_on(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(licenses, "fit", seen.extend)
    long = "word " * 500 + "and a fishing license"
    licenses.train(spark.createDataFrame([(1, f"First.\nplain\n{long}\nReleased under the MIT License."), (2, "Other.")], "doc_id long, text string"))
    assert sorted(seen) == sorted(["First.", "Other.", long])


# 4 --------------------------------------------------------------------------------------------
def cut_all(texts, window=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + window] for x in data for i in range(len(x) - window + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append((len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(b for b, c in zip(x, gone) if not c)))
    return out


@pytest.mark.parametrize("window", [repeats.WINDOW, repeats.PASSAGE])
def test_repeats(docs, none, window):
    got = repeats.without_repeats(docs, ["doc_id"], window=window).collect()
    want = [(i, *r[:3], hashlib.sha256(r[3]).hexdigest(), r[3].decode("utf-8", "ignore")) for (i, _), r in zip(ROWS, cut_all((t for _, t in ROWS), window))]
    assert bag(got) == bag(want)
    assert repeats.without_repeats(none, ["doc_id"]).count() == 0


def test_repeats_beside_columns_of_the_same_names(docs):
    names = ["n_bytes", "kept_text", "__key", "__own", "__out", "key", "n_removed"]
    clash = docs.select("doc_id", "text", *[docs["n"].alias(c) for c in names])
    out = repeats.without_repeats(clash, ["doc_id", "n_bytes", "__key", "__own"])
    assert out.columns == ["doc_id", "__key", "__own", *repeats.OUTPUT]
    assert Counter(r.n_bytes for r in out.collect()) == Counter(len((t or "").encode()) for _, t in ROWS)
    staged = repeats.cut_documents(clash)
    assert staged.columns == clash.columns
    assert sorted((r["n_bytes"], r["__key"]) for r in staged.collect()) == [(k, k) for k in range(len(ROWS))]


def test_repeats_at_the_window_and_over_segments(spark):
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    a, far = noise(401), noise(2000)
    texts = [a, "q" + a[1:], noise(399), "é" + noise(700), noise(300) + far[:600] + noise(300), noise((1 << 20) + 500) + far + noise(900)]
    texts += [texts[2] + "!", "ab" * 450, "c" * 399, "c" * 400, "d" * 401]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = repeats.without_repeats(df, ["doc_id"]).drop("kept_text").collect()
    assert bag(got) == bag((i, *r[:3], hashlib.sha256(r[3]).hexdigest()) for i, r in enumerate(cut_all(texts)))


def test_passages_beside_the_window(spark, docs):
    """Both windows by brute force; runs of passages within, at and above a window, in copies and over the edge of a segment."""
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    far, edge = noise(2000), noise(900)
    texts = [noise(50) + far[a:b] + noise(70) for a, b in ((0, 199), (0, 200), (150, 550), (600, 999), (600, 1400), (1000, 2000), (1100, 1500), (1399, 1799))]
    texts += [noise((1 << 20) - 450) + edge + noise(900), noise(90) + edge, "é" + edge[:420], edge[300:500], edge[300:500], far, far, "ab" * 450, "c" * 250, None, ""]
    mine = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df, rows in ((mine, texts), (docs, [t for _, t in ROWS])):
        got = repeats.without_repeats(df, ["doc_id"], passage=repeats.PASSAGE)
        assert got.columns == ["doc_id", *repeats.OUTPUT, *repeats.PASSAGE_OUTPUT]
        both = zip(cut_all(rows), cut_all(rows, repeats.PASSAGE))
        want = [(*w[:3], hashlib.sha256(w[3]).hexdigest(), w[3].decode("utf-8", "ignore"), *p[1:3], p[3].decode("utf-8", "ignore")) for w, p in both]
        assert bag(got.drop("doc_id").collect()) == bag(want)
    with pytest.raises(ValueError):
        repeats.without_repeats(mine, ["doc_id"], passage=repeats.WINDOW)


def test_passages_of_over_fifty_words_are_cut_out(spark, tmp_path):
    """Passages shorter than the contract's window, which leaves them alone."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 6))) for _ in range(n))
    passages = [words(52 + k) for k in range(8)]
    assert all(200 <= len(x) + 2 < 400 for x in passages)
    rows = [(2 * i + j, f"{words(80)} {x} {words(60)}") for i, x in enumerate(passages) for j in (0, 1)] + [(100 + i, words(150)) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in repeats.op4_repeats(spark, str(tmp_path)).collect()}
    for i, text in rows:
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_text) == (len(text), 0, text)
        assert (got[i].passage_text == text) == (got[i].passage_removed == 0) == (i >= 100)
        assert i >= 100 or passages[i // 2] not in got[i].passage_text and got[i].passage_removed >= len(passages[i // 2])


# 5 --------------------------------------------------------------------------------------------
def test_main_text_of_a_page():
    long = "This is a sentence of the article with some length. " * 8
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><a href=/>Site</a></header>
      <nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies.</div>
      <div id=content><h1>Title &amp;  more</h1><p>{long}<p>Second &lt;b&gt; <b>bold</b> text. {long}<ul><li>item one<li>item two</ul><script>var x = "<p>no</p>";</script></div>
      <div class="comments"><p>Nice post! {long}</div><aside>Ad</aside><form><input>Mail</form><footer>&copy; 2020</footer></body></html>"""
    got = html_text.main_text(page)
    one = " ".join(long.split())
    assert got.split("\n") == ["Title & more", one, f"Second <b> bold text. {one}", "item one", "item two"]


def _story(*names, n=300):
    return {x: (f"{x} says this much of the story. " * 40)[:n].strip() for x in names}


def test_an_article_in_sibling_blocks_keeps_all_of_them_and_its_heading():
    s = _story(*"abcde")
    p = {k: f"<p>{v}</p>" for k, v in s.items()}
    page = f"<body><h1>Head</h1><div>{p['a']}{p['b']}{p['c']}</div><h2>More</h2><div>{p['d']}{p['e']}</div><div class=x1><p>Side</p><a href=/1>one</a><a href=/2>two</a></div></body>"
    assert html_text.main_text(page).split("\n") == ["Head", s["a"], s["b"], s["c"], "More", s["d"], s["e"]]


def test_a_wrapper_and_unlisted_names_do_not_bring_side_text():
    s = _story(*"abcde")
    side = "<div class=x7><h3>Hot now</h3><p>Top ten.</p><ul><li><a href=/1>First of them</a><li><a href=/2>Second of them</a></ul></div>"
    page = f"<body><div id=w>{side}<h1>Head</h1><div class=x8>{''.join(f'<p>{x}</p>' for x in s.values())}</div>{side}</div></body>"
    assert html_text.main_text(page).split("\n") == ["Head", *s.values()]


def test_a_class_name_alone_drops_no_article():
    s = _story(*"abcde")
    story = "".join(f"<p>{x}</p>" for x in s.values())
    for name in ("page right-sidebar", "search", "widget legal"):
        page = f"<body><div class='{name}'><div>{story}</div><div class=ad><p>Buy this.</p></div></div><div class=side><a href=/1>one</a> <a href=/2>two</a></div><p>Foot</p></body>"
        assert html_text.main_text(page).split("\n") == [*s.values()], name


def _naive(node, own_named):
    """Characters, link characters, tags and link tags under a node, counted by walking it."""
    chars = sum(len(x.strip()) for x in node.items if isinstance(x, str))
    links = tags = link_tags = 0
    for x in node.items:
        if isinstance(x, str) or x.drop:
            continue
        c, l, t, lt = _naive(x, own_named)
        if not x.named:
            chars, links, tags, link_tags = chars + c, links + l, tags + t + 1, link_tags + lt
    if node.tag == "a":
        links, link_tags = chars, link_tags + 1
    return chars, links, tags, link_tags


def test_densities_equal_a_plain_walk(spark):
    """Every node's composite density and density sum, and the node chosen, against counts by walking each subtree."""
    pages = [r.html for r in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").limit(60).collect() if r.html]
    pages += ["<body><div class=wrap><ul>" + "<li><a href=/x>link text</a>" * 9 + "</ul><div><p>" + "Words of the story. " * 40 + "<p>" + "More of it. " * 50 + "</div></div></body>"]
    for page in pages:
        root = html_text.parse(page)
        nodes = [n for n in html_text._measure(root) if not n.drop]
        c0, l0, _, _ = _naive(root, True)
        sums = {}
        for n in nodes:
            c, l, t, lt = _naive(n, True)
            assert (n.chars, n.links, n.tags, n.link_tags) == (c, l, t, lt)
            plain, density = max(c - l, 1), 0.0
            if c:
                base = np.log(c / plain * l + l0 / max(c0, 1) * c + np.e)
                density = c / max(t, 1) * np.log(max(c / max(l, 1) * max(t, 1) / max(lt, 1), 1.0)) / max(np.log(max(base, 1.0001) + 1), 1e-6)
            assert n.density == pytest.approx(density, rel=1e-9, abs=1e-12)
            sums[id(n)] = density
        for n in nodes:
            assert n.sums == pytest.approx(sum(sums[id(x)] for x in n.items if not isinstance(x, str) and not x.drop and not x.named), rel=1e-9, abs=1e-9)


def test_main_text_of_long_pages_and_headings_with_telling_ids():
    story = "".join(f"<p>Sentence {i} of a very long page that goes on.</p>" for i in range(40_000))
    assert html_text.main_text(f"<body><div>{story}</div></body>").count("\n") == 39_999
    page = f"<body><article><h2 id=copyright>On rights</h2><section class=legal>{''.join(f'<p>{x}</p>' for x in _story(*'abcde').values())}</section></article></body>"
    assert html_text.main_text(page).split("\n") == ["On rights", *_story(*"abcde").values()]


def test_clashing_columns_and_empty_tables(spark, none):
    """Extra columns that have the names of outputs or of columns used inside change nothing."""
    more = ["text_crc32", "size", "score", "n_tokens", "found", "license", "fp", "root", "key", "ws", "h", "shingle", "item", "piece", "length", "rank", "class", "shard", "predicted", "toxic", "n_chars", "base_failed", "kept"]
    rows = [(i, f"text number {i} with some words in it", "h", *["?"] * len(more)) for i in range(6)]
    wide = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in more))
    slim = wide.select("doc_id", "text", "source")
    labels = slim.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    items = slim.select(F.col("doc_id").alias("item_id"), "text")
    runs = {
        1: token_counts.token_counts, 2: quality.quality_rules, 3: lambda d: licenses.licences(d, licenses.train(slim)), 6: lambda d: toxicity.score(d, toxicity.train(slim, labels)), 7: sharding.shard,
        8: packing.pack_documents, 9: lambda d: decontam.contaminated(d, items), 10: simhash.component_ids,
    }
    for n, run in runs.items():
        a, b = run(slim), run(wide)
        shared = [c for c in a.columns if c in b.columns]
        rows_of = lambda df: Counter(str(r) for r in df.select(*shared).drop("sequence_id", "offset").collect())  # noqa: B023, E731
        assert rows_of(a) == rows_of(b), n
        assert run(wide.limit(0)).count() == 0, n
    pages = wide.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "text", "n_chars")
    assert [r.text for r in html_text.extract(pages).orderBy("page_id").collect()] == [r[1] for r in rows]
    assert html_text.extract(pages.limit(0)).count() == 0
    for f in (quality.keep_good, simhash.one_of_each, lambda d: decontam.drop_contaminated(d, items)):
        assert f(wide).columns == wide.columns


def test_working_names_of_the_quality_rules_are_free(spark):
    rows = [(i, f"text number {i} with some words " * 12, "h", "x") for i in range(4)]
    slim = spark.createDataFrame(rows, "doc_id long, text string, source string, v string")
    want = [tuple(r) for r in quality.quality_rules(slim.drop("v")).orderBy("doc_id").collect()]
    for name in ("__t", "__w", "__l", "__h", "__o", "__p", "__host", "__bad", "___t", "kept"):
        got = quality.quality_rules(slim.withColumnRenamed("v", name))
        assert [tuple(r) for r in got.orderBy("doc_id").select("doc_id", "text", "source", *[c for c in quality.quality_rules(slim).columns if c not in ("doc_id", "text", "source", "v")]).collect()] == want, name
        assert name in got.columns


def test_windows_that_the_parse_cannot_hold_are_refused(spark, docs):
    for window in (8, 40_000):
        with pytest.raises(ValueError, match="window"):
            repeats.without_repeats(docs, ["doc_id"], window=window)


def test_very_long_texts(spark):
    """Texts beyond every inner chunk: 90,000 words."""
    rng = random.Random(9)
    long = " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(90_000))
    df = spark.createDataFrame([(1, long, "h"), (2, long + " end", "h"), (3, "short text", "h")], "doc_id long, text string, source string")
    fig = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert fig[1].n_words == 90_000 and fig[2].n_words == 90_001
    got = simhash.component_ids(df).collect()
    want = slow_components([(i, slow_fingerprint(t)) for i, t in ((1, long), (2, long + " end"), (3, "short text"))])
    assert bag((r.doc_id, r.fingerprint, r.component_id) for r in got) == bag(want)
    counts = token_counts.token_counts(df).collect()
    assert min(r.n_tokens for r in counts if r.doc_id < 3) > 90_000
    pieces = packing.pack_documents(df).where("doc_id = 1").collect()
    assert sum(r.length for r in pieces) > 90_000 and max(r.length for r in pieces) <= 2048
    item = spark.createDataFrame([(7, " ".join(long.split()[70_000:70_040]))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.contaminated(df, item).collect()) == [1, 2]


def test_odd_pages(spark):
    rows = [(0, "u", None), (1, "u", ""), (2, "u", "<p>"), (3, "u", "only text"), (4, "u", "<div>" * 3000 + "deep &eacute;"), (5, "u", "<script>x"), (6, "u", "<body><p>a<p>b</body>"), (6, "u", "<body><p>a<p>b</body>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert bag((r.page_id, r.text, r.n_chars) for r in got) == Counter({(0, "", 0): 1, (1, "", 0): 1, (2, "", 0): 1, (3, "only text", 9): 1, (4, "deep é", 6): 1, (5, "", 0): 1, (6, "a\nb", 3): 2})


# 6 --------------------------------------------------------------------------------------------
def test_folding():
    assert toxicity.fold("1D10T, ѕtuріd​!") == " idiot stupid "
    assert toxicity.fold(None) == "  " == toxicity.fold("\n")


def test_toxicity_on_held_out_labels(spark):
    """Labels are noisy; the lexicon finds most toxic documents of the fold it never saw and few others."""
    d = f"{DATA}/sf0.1"
    got = queries.queries()["op6_toxicity"](spark, d)
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = got.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    n = Counter((r.toxic, r.predicted) for r in rows)
    assert n[1, 1] >= 0.8 * (n[1, 1] + n[1, 0]) and n[0, 1] <= 0.03 * (n[0, 1] + n[0, 0])


def test_matching_equals_a_plain_search():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 6)))
    lexicon = {f" {word()}" + rng.choice(["", " "]): rng.uniform(0.5, 3) for _ in range(60)} | {" aa": 1.0, " aab": 1.0}
    texts = [" " + " ".join(word() for _ in range(rng.randint(0, 80))) + " " for _ in range(60)] + ["  "]
    ban = {x for t in texts[:20] for s in toxicity.Matcher(lexicon).hits(t) for x in toxicity.Matcher(lexicon).phrases(t, s) if rng.random() < 0.2 and " " in x}
    m = toxicity.Matcher(lexicon, ban)
    for t in texts:
        ws, total = t.split(), 0.0
        for i, w in enumerate(ws):
            best = max((x for k, x in lexicon.items() if f" {w} ".startswith(k)), default=0.0)
            around = {" ".join(ws[max(i - 1, 0) : i + 1]), " ".join(ws[i : i + 2])}
            total += 0.0 if around & ban else best
        assert m.evidence(t) == pytest.approx(total / np.log2(16 + t.count(" ")))


def test_toxicity_of_odd_labels(spark):
    """Null labels and ids teach nothing; equal texts get equal scores; extra columns do not matter."""
    rows = [(i, "foul nastyword here" if i % 2 else "a kind word here", i % 2, "x") for i in range(40)] + [(None, "foul", 1, "x"), (41, None, None, None), (2, "a kind word here", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, score string")
    labels = docs.select("doc_id", docs["n"].cast("int").alias("quality"), docs["n"].cast("int").alias("toxic"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id is not None and r.doc_id < 40 and r.doc_id % 2}) == 1
    assert min(r.score for r in got if r.doc_id in (1, 3, 5)) > 0.5 > max(r.score for r in got if r.doc_id in (2, 4, 41))


def test_toxicity_without_labels(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, empty)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


# 7 --------------------------------------------------------------------------------------------
def test_shards(spark, docs, none):
    for df, rows in ((docs, ROWS), (spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), None)):
        rows = rows or [(r.doc_id, r.text) for r in df.collect()]
        got = sharding.shard(df).collect()
        assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == bag((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        slots, load, shards = defaultdict(list), Counter(), defaultdict(set)
        for r in got:
            slots[r.shard].append(r.slot)
            load[r.shard] += r.size
            shards[r.text_crc32].add(r.shard)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in shards.values())
    groups = Counter()
    for _, t in rows:
        groups[t] += len((t or "").encode()) + 1
    assert max(load.values()) <= max(max(groups.values()), 1.01 * sum(load.values()) / 16)
    assert sharding.shard(none).count() == 0


def test_schedule_equals_one_item_at_a_time():
    rng = random.Random(2)
    for sizes in ([rng.randint(1, 40) for _ in range(3000)], [5000] + [3] * 4000 + [2] * 77, [7] * 15, [], [9, 9, 9], [10**9] + [rng.randint(1, 9) for _ in range(500)]):
        plain = [0] * 16
        for x in sorted(sizes, reverse=True):
            plain[plain.index(min(plain))] += x
        dealt = sharding.longest_first([(k, float(k), n) for k, n in Counter(sizes).items()], 16)
        assert {k: sum(g) for k, g in dealt.items()} == Counter(sizes)
        assert sorted(sum(k * g[s] for k, g in dealt.items()) for s in range(16)) == sorted(plain)


def test_size_classes(spark):
    rows = spark.createDataFrame([(x,) for x in (1, 8191, 8192, 8193, 16385, 16386, 10**9 + 7)], "s long").select("s", sharding.size_class(F.col("s")).alias("c")).collect()
    assert all(0 <= r.s - r.c <= r.s / 4096 for r in rows) and rows[0].c == 1 and rows[1].c == 8191


# 8 --------------------------------------------------------------------------------------------
def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = packing.pack_documents(docs).collect()
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in ROWS]
    want = []
    for i, x in ids:
        first = len(x) % 2048 or 2048
        at = [0, *range(first, len(x), 2048), len(x)] if len(x) > 2048 else [0, len(x)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == bag(want)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for x in seqs.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-sum(len(x) for _, x in ids) // 2048) + 1
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a \n b ", "  x  y", "a\x1c b \x1cb", "it's  we'll 12 345", "<|endoftext|> x", "tab\t tab", "  ", "日本 語\r\n x"])
def test_ids_equal_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    assert packing.Encoder(path).ids(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_equal_the_tokenizer_for_every_character():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    assert enc.fast is not None
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c}1 {c} {c}b\n" for c in chars[k : k + 512]) for k in range(0, len(chars), 512)] + [" " * 3_000_000 + "x"]
    for t, e in zip(texts, tok.encode_batch_fast(texts, add_special_tokens=False)):
        assert enc.ids(t) == np.array(e.ids, "<u4").tobytes()


def test_plan_uses_exact_complements():
    assert sorted(sorted(p) for p, _ in packing.plan({1000: 1, 1048: 1, 1500: 1, 300: 1, 248: 1, 2048: 2})) == [[248, 300, 1500], [1000, 1048], [2048]]


# 9 --------------------------------------------------------------------------------------------
def low_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(ws, w):
    return {tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)}


def test_contained_items(spark, docs, none):
    pick = [t for _, t in ROWS if t and len(t.split()) > 40]
    items = [(0, None), (1, ""), (2, "one two"), (3, " ".join(pick[0].split()[5:30]).upper()), (4, " ".join(pick[1].split()[:20] + ["changed"] + pick[1].split()[20:40])), (5, "not there at all in any text"), (6, " ".join(pick[1].split()[:40]))]
    items = items + items[3:4]
    df = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, key int")
    want = []
    for i, t in ROWS:
        for k, x in items:
            ws, ds = low_words(x), low_words(t)
            if ws:
                own = shingles(ws, min(5, len(ws)))
                n = len(own & shingles(ds, min(5, len(ws))))
                if n >= 0.8 * len(own):
                    want.append((i, k, len(own), n))
    got = decontam.contaminated(docs, df).select("doc_id", "item_id", "n_item", "n_shared").collect()
    assert want and bag(got) == bag(want)
    left = decontam.drop_contaminated(docs, df).select("doc_id").collect()
    assert bag(left) == bag((i,) for i, _ in ROWS) - bag((i,) for i, t in ROWS if any(w[0] == i for w in want) and t)
    assert decontam.contaminated(none, df).count() == 0 == decontam.contaminated(docs, df.limit(0)).count()


# 10 -------------------------------------------------------------------------------------------
def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    ws = low_words(text)
    if not ws:
        return 0
    hs = [xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(pairs):
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 3 and top(a) != top(b):
                root[top(b)] = top(a)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return [(i, f"{f:016x}", least.get(top(f))) for i, f in pairs]


def test_simhash(docs, none):
    want = slow_components([(i, slow_fingerprint(t)) for i, t in ROWS])
    assert bag(simhash.component_ids(docs).collect()) == bag(want)
    assert simhash.component_ids(none).count() == 0
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len({c for _, _, c in want})


@pytest.mark.parametrize("most", [4096, 8])
def test_all_links_whatever_the_bucket_bound(spark, most):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in fps[:60]:
        for n in (1, 2, 3, 4):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.append(g)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.components(simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), most)).collect()
    unsigned = lambda x: x & simhash.ALL
    got = defaultdict(set)
    for r in links:
        got[r.root].add(unsigned(r.node))
    want = defaultdict(set)
    for i, _, c in slow_components(list(enumerate(fps))):
        want[c].add(fps[i])
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
