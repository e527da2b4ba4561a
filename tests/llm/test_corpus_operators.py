"""Near-duplicate join, substring removal, site trees, neighbours and preferences."""

import os
import random
import re
import tracemalloc
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import anchors, common, ngram_join, nn_descent, preferences, shingles, site_tree, suffix_dedup
from siftline.llm.common import components
from siftline.llm.suffix_groups import suffix_array
from siftline.session import cut_lineage

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(n)]


def near_copies(seed=1):
    """Texts with groups of copies, edited copies, shared passages and short texts."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = []
    for _ in range(12):
        base = words(rng, rng.randrange(20, 300))
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 20])):
                copy[rng.randrange(len(copy))] = "".join(rng.choices("xyz", k=4))
            texts.append(" ".join(copy))
    texts += [" ".join(words(rng, 30) + passage + words(rng, 30)) for _ in range(10)]
    texts += ["", None, "  \n", "One two", "one  TWO", "one", "A b C", "a\tb c", "é É", "É É"]
    return texts


def plain_components(texts, width, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("width,percent,tile", [(3, 90, 256), (5, 80, 2)])
def test_jaccard_components_match_all_pairs(spark, monkeypatch, width, percent, tile):
    monkeypatch.setattr(ngram_join, "TILE_NODES", tile)
    monkeypatch.setattr(ngram_join, "SHARD_TILES", 1)
    texts = near_copies()
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOC).withColumns({"n": F.lit(1), "node": F.lit("x"), "row": F.lit(2)})
    want, sizes = plain_components(texts, width, percent)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(df, width, percent).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    kept = ngram_join.keep_one(df, width=width, percent=percent)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_a_group_of_near_copies_gives_pairs_in_proportion(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = []
    for k in range(150):
        words = list(base)
        words[rng.randrange(20, 60)] = f"own{k}"
        texts.append(" ".join(words))
    made = []
    plain = ngram_join.linked_pairs
    monkeypatch.setattr(ngram_join, "linked_pairs", lambda docs, pairs, *a: (made.append(pairs.count()), plain(docs, pairs, *a))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ngram_join.jaccard_components(df, 3, 80).collect()
    assert {r["component_id"] for r in rows} == {0}
    # all pairs would be 11,175; the second round finds nothing left to join
    assert made[0] < 1500 and made[1] == 0


def test_the_join_ships_texts_and_makes_prefixes_once(spark, monkeypatch):
    """On 0.51 GB the sets of 64-bit shingles, stored and dealt out, passed the disk limit."""
    rng = random.Random(3)
    texts = []
    for _ in range(10):
        base = [rng.choice("abcdefgh") + rng.choice("abcdefgh") + rng.choice("ij") for _ in range(2000)]
        texts += [" ".join(base), " ".join([*base, "end"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held, plain = {}, ngram_join.cut_lineage

    def measured(table, name="cut", *options):
        held.setdefault(name, table._jdf.queryExecution().executedPlan().toString())
        out = plain(table, name, *options)
        held["bytes"] = held.get("bytes", 0) + sum(os.path.getsize(f.removeprefix("file:")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(ngram_join, "cut_lineage", measured)
    assert [r["component_id"] for r in ngram_join.jaccard_components(df).orderBy("doc_id").collect()] == [i // 2 * 2 for i in range(20)]
    assert held["lists"].split("Initial Plan")[-1].count("MapInArrow") == 1
    # texts meet in the shards that the links are counted in; what is stored beside them is less than the texts
    assert "array<bigint>" not in held["links"] and held["bytes"] < sum(map(len, texts))


def test_least_firsts_are_dealt_into_blocks(spark, monkeypatch):
    """All sets of one least first in one shard would grow with the group."""
    monkeypatch.setattr(ngram_join, "TILE_NODES", 4)
    pairs = spark.createDataFrame([(a, b, 9, 9) for a in range(100, 300) for b in (1, 2)], "a long, b long, na long, nb long")
    dealt = ngram_join._star_shards(pairs).collect()
    assert sorted((r["a"], r["b"]) for r in dealt) == [(a, b) for a in range(100, 300) for b in (1, 2)]
    assert len({(r["a"], r["shard"]) for r in dealt}) == 200 and max(Counter(r["shard"] for r in dealt).values()) < 60


def test_pairs_that_cannot_link_are_not_made(spark, monkeypatch):
    """All sets share a passage; only the copies of one base are near, in many shared shingles."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage = [word() for _ in range(60)]
    texts = [" ".join([*passage, *(word() for _ in range(40 + k % 3))]) for k in range(60)]
    large = [word() for _ in range(900)]
    texts += [" ".join([*large[:800], *(word() for _ in range(300))]) for _ in range(12)] + [" ".join(large), " ".join([*large, "end"])]
    made, plain = [], ngram_join.linked_pairs
    monkeypatch.setattr(ngram_join, "linked_pairs", lambda docs, pairs, *a: (made.append(pairs.count()), plain(docs, pairs, *a))[1])
    # places of one order by hash, so that the passage stands in the prefixes
    monkeypatch.setattr(ngram_join, "global_order", lambda summary: (np.zeros(1 << ngram_join.BUCKET_BITS, np.int32), np.zeros(1 << ngram_join.BUCKET_BITS, np.int8)))
    rows = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: min(i, 72) for i in range(74)}
    assert made == [1, 0]


def test_jaccard_join_of_odd_tables(spark):
    rows = [(None, "a b c d", None, None, 0), (5, "a b c d", None, None, 0), (5, "a b c d", None, None, 0), (None, None, None, None, None), (9, "q w e r", "x", "y", 1)]
    df = spark.createDataFrame(rows, DOC)
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.jaccard_components(df).where("n_shingles > 0").collect())
    assert got == [(-1, 5), (5, 5), (5, 5), (9, 9)]
    assert ngram_join.keep_one(df).count() == 3
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0 and ngram_join.keep_one(df.limit(0)).count() == 0


def test_shingles_follow_word_bounds():
    a, b = shingles.shingle_sets([b"ab c d", b"a bc d"], 3)
    assert len(a) == len(b) == 1 and a[0] != b[0]
    same = shingles.shingle_sets([b"AB c\td", b" ab  c d\n", "é x y".encode(), "É x y".encode()], 3)
    assert same[0][0] == same[1][0] and same[2][0] != same[3][0]


def test_components_of_chains_stars_and_dense_groups(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    dense = [(i, j) for i in range(300, 330) for j in range(300, i)]
    star = [(500, 500 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    links = chain + dense + star
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    got = dict((r["node"], r["root"]) for r in components(df).collect())
    want = {i: 100 for i in range(100, 161)} | {i: 300 for i in range(300, 330)} | {i: 500 for i in range(500, 540)}
    assert got == want
    assert components(df.limit(0)).count() == 0


def test_rounds_over_few_links_are_stored_by_few_tasks(spark, monkeypatch):
    written = []

    def store(df, name="cut", compression=None):
        written.append((name, df))
        return cut_lineage(df, name, compression)

    monkeypatch.setattr(common, "cut_lineage", store)
    monkeypatch.setattr(common, "PARTITION_ROWS", 150)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # a chain of 200, twice and with odd rows: no round may take 40 tasks for 400 links
        rows = [(i, i + 1) for i in range(200)] * 2 + [(None, 1), (7, 7)]
        found = components(spark.createDataFrame(rows, "a long, b long").repartition(3))
        tasks = [df.rdd.getNumPartitions() for name, df in written if name == "star"]
        assert len(tasks) > 2 and max(tasks) <= 3 and found.rdd.getNumPartitions() <= 6
        assert sorted(tuple(r) for r in found.collect()) == [(i, 0) for i in range(201)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_shared_windows_take_bounded_memory():
    rng = random.Random(3)
    parts = [bytes(rng.choices(range(97, 123), k=76)) for _ in range(20)]
    rows = [(core, rng.choice(parts)[:75] + rng.choice(parts)[:75], 75, 76) for core in range(20) for _ in range(30)]
    tracemalloc.start()
    suffix_dedup.repeated_windows(rows, 76)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * sum(len(body) + 2 for _, body, _, _ in rows)
    # tables for one block of texts, which the longest piece of a text fills
    assert max(map(len, (anchors._POWERS, anchors._INVERSES))) <= anchors.BLOCK + 1
    text = rng.randbytes(anchors.BLOCK + 500)
    blocks = [(first, last, base) for _, bases, _, _, first, last, _, _ in anchors.scan_texts([text], 400) for base in bases]
    starts = np.concatenate([np.arange(f, g + 1) + base for first, last, base in blocks for f, g in zip(first, last)])
    assert set(starts.tolist()) == set(range(len(text) - 399))


def test_suffix_array_orders_all_suffixes():
    rng = random.Random(1)
    for _ in range(3000):
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(0, 25))] * rng.choice([1, 1, 1, 3])
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def repeated(texts, window=suffix_dedup.WINDOW):
    """Per text the bytes left, removed and the number of runs, by counting all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def repeating_texts():
    rng = random.Random(8)
    text = lambda n: " ".join(words(rng, n))
    passage, long = text(150), text(600)
    texts = [text(200), long, long, None, "", "é" * 300, "x" * 399, "y" * 400, "y" * 401, "ab" * 1500, text(50)]
    texts += [text(rng.randrange(5, 60)) + " " + passage[rng.randrange(0, 60):len(passage) - rng.randrange(0, 60)] + text(40) for _ in range(25)]
    for _ in range(8):
        copy = list(long)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    return texts + [passage[:400], passage[:400] + "é", text(20_000)]


@pytest.mark.parametrize("most", [5000, 1])
def test_repeated_strings_go_as_counting_all_windows_says(spark, most):
    texts = repeating_texts()
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOC).withColumns({"core": F.lit(1), "text_hash": F.lit("x")}).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_substrings(df, most=most, shard_symbols=2000).collect()}
    want = repeated(texts)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []


@pytest.mark.parametrize("window,most", [(240, 5000), (240, 1), (97, 5000)])
def test_other_widths_than_the_contract_go_as_counting_says(spark, window, most):
    texts = repeating_texts()
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOC).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_substrings(df, window=window, most=most, shard_symbols=2000).collect()}
    want = repeated(texts, window)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []


def test_applied_removal_keeps_columns_and_drops_emptied_documents(spark):
    texts = repeating_texts()
    df = spark.createDataFrame([(i, t, "l", "s", 0) for i, t in enumerate(texts)], DOC).withColumns({"kept": F.lit(1), "n_bytes": F.lit("x"), "doc": F.lit(2)})
    out = suffix_dedup.apply_dedup(df)
    assert out.columns == df.columns
    ids = {r["doc_id"]: r for r in out.collect()}
    want = repeated(texts)
    assert set(ids) == {i for i, (n, gone, _, _) in enumerate(want) if not gone or gone < n}
    assert all(r["text"] == texts[i] for i, r in ids.items() if not want[i][1])
    assert suffix_dedup.apply_dedup(df.limit(0)).count() == 0


PAGE = "<html><head><title>t</title></head><body><nav>menu <a href=x>a</a></nav><div class='strip'>{strip}</div><article><h1>{h}</h1><p>{p}<p>two &amp; three<br>four</article><div class=comments>no</div><footer>f</footer></body></html>"


def test_template_branches_of_a_host_go(spark):
    rng = random.Random(5)
    pages = [(i, "http://user@Host.example:80/a", PAGE.format(strip="Same strip on all pages", h=f"Title {i}", p=" ".join(words(rng, 40))).replace("article", "section")) for i in range(12)]
    pages += [(50 + i, "http://third.example/a", PAGE.format(strip=" ".join(words(rng, 5)), h=f"Title {i}", p=" ".join(words(rng, 40))).replace("article", "section")) for i in range(12)]
    pages += [(100 + i, "https://other.example/x", PAGE.format(strip=" ".join(words(rng, 5)), h="T", p="body")) for i in range(8)]
    pages += [(200, None, "<p>alone"), (201, "http://z.example", None), (201, "http://z.example", None), (202, "nonsense", "plain &lt;text&gt; &#233;")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit(1), "paths": F.lit(2)})
    got = {r["page_id"]: r for r in site_tree.extract_text(df).collect()}
    for i, _, html in pages[:12]:
        p = re.search("<p>(.*?)<p>", html)[1]
        assert got[i]["text"] == f"Title {i}\n{p}\ntwo & three four" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[50]["text"].count("\n") == 3  # its strip differs from page to page
    assert got[100]["text"] == "T\nbody\ntwo & three four"
    assert got[200]["text"] == "alone" and got[201]["text"] == "" and got[202]["text"] == "plain <text> é"
    assert site_tree.extract_text(df.limit(0)).count() == 0


def test_the_tree_decides_inside_articles_too(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(words(rng, n))
    page = "<body><article><h1>{h}</h1><p>{p}</p><div class=pitch><p>Read on every day</p></div></article><div class=strip>{s}</div></body>"
    marked = [(i, "http://a.example/x", page.format(h=text(3), p=text(60), s=text(5))) for i in range(12)]
    cards = [(100 + i, "http://b.example/x", f"<div class=body><h1>{text(3)}</h1><p>{text(80)}</p></div><article><p>Read on every day</p></article>") for i in range(12)]
    loose = [(200, "http://c.example/x", f"<div class=body><p>{text(80)}</p></div><article><p>{text(4)}</p></article>")]
    df = spark.createDataFrame(marked + cards + loose, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_tree.extract_text(df).collect()}
    for i, _, html in marked + cards:
        assert got[i] == "\n".join(re.findall("<(?:h1|p)>(.*?)</", html)[:2])
    assert got[200] == "\n".join(re.findall("<p>(.*?)</p>", loose[0][2]))


@pytest.mark.parametrize("html,blocks", [
    ("a<script>if (a<b) '</p>'</script>b", ["ab"]),
    ("<p>x <!-- <p> no --> y</p>z", ["x y", "z"]),
    ("<ul><li>a<li>b <ul><li>c</ul></ul>", ["a", "b", "c"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<div>a<b>b</b>c <span class='ad'>no</span> d</div>", ["abc d"]),
    ("<article><header><h1>T</h1></header>x</article><header>no</header>", ["T", "x"]),
    ("</p></div>a < b<", ["a < b<"]), ("<main class='no-sidebar'>k</main><div id='site-menu'>m</div>", ["k"]), ("<textarea>no</textarea>&nbsp; q &bogus;", ["q &bogus;"]),
])
def test_blocks_of_a_page(html, blocks):
    assert [text for _, text in site_tree.Page(html).blocks] == blocks


@pytest.mark.parametrize("attributes,noise", [
    ('style="overflow:hidden"', False), ('href="/the-hidden-cost"', False), ('data-id="nav"', False), ("href=/x?id=menu", False), ('title="role=navigation"', False),
    ("HIDDEN", True), ('data-x="1"hidden=""', True), ("aria-hidden=true", True), ("id = 'menu'", True), ('style="a:b" class="x\nsidebar"', True),
])
def test_attributes_are_read_by_their_whole_names(attributes, noise):
    assert [text for _, text in site_tree.Page(f"<p>a <span {attributes}>b</span></p>").blocks] == (["a"] if noise else ["a b"])


def test_neighbours_reach_recall_on_a_table_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + i, x[5].tolist()) for i in range(60)]
    rows += [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [1.0, None] * 8), (3400, [1.0, 2.0]), (None, [1.0] * 16), (3500, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"node": F.lit(1), "dim": F.lit("x")})
    got = nn_descent.search_table(df).toPandas()
    ids = np.array([r[0] for r in rows[:1560]])
    vectors = np.array([r[1] for r in rows[:1560]])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        want = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and q not in set(mine["vec_id"])
        assert np.allclose(mine["score"], [d[ids == v][0] for v in mine["vec_id"]], atol=1e-12)
        assert sorted(zip(mine["score"], mine["vec_id"])) == list(zip(mine["score"], mine["vec_id"]))
        hits += len(set(ids[want]) & set(mine["vec_id"]))
        total += 10
    assert hits / total >= 0.95
    assert set(got["query_id"]) == set(ids[ids % 100 == 0])
    assert nn_descent.search_table(df.limit(0)).count() == 0


def test_few_vectors_return_all_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nn_descent.search_table(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]


def test_preferences_share_the_longest_prefix(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "ok"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "no"), (2, 3, "assistant", None)]
    turns += [(3, 0, "user", "z"), (3, 0, "user", "z"), (None, 0, "user", "lost"), (4, None, "user", "lost"), (5, 1, "user", "hi"), (5, 0, None, None)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))
    convs = preferences.conversations(df)
    pairs = spark.createDataFrame([(0, 1, 2), (1, 1, 1), (2, 3, None), (3, 9, 3), (4, None, None)], "pair_id bigint, chosen_id bigint, rejected_id bigint")
    got = {r["pair_id"]: r for r in preferences.format_preferences(pairs, convs).collect()}
    part = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    r = got[0]
    assert r["n_prompt_turns"] == 2 and r["prompt"] == part("user", "hi") + part("assistant", "yo")
    assert r["chosen"] == part("user", "ok") and r["rejected"] == part("user", "no") + part("assistant", "")
    assert r["chosen_mask"] == "19:0" and r["rejected_mask"] == "19:0 22:1"
    assert (got[1]["n_prompt_turns"], got[1]["chosen"], got[1]["rejected"]) == (3, "", "")
    assert (got[2]["n_prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (0, part("user", "z"), None)
    assert got[3]["chosen"] is None and got[3]["rejected"] == part("user", "z") and got[4]["prompt"] == ""
    paired = sorted((r["chosen_id"], r["rejected_id"]) for r in preferences.pair_up(convs).where("rejected_id is not null").collect())
    assert paired == [(1, 2)]
    built = {r["chosen_id"]: r["reply_id"] for r in preferences.pair_up(convs).where("rejected_id is null").collect()}
    assert built == {3: None, 5: None}  # neither has an assistant turn
    assert preferences.format_preferences(preferences.pair_up(preferences.conversations(df.limit(0))), convs).count() == 0


@pytest.mark.parametrize("block", [3, 4096])
def test_all_twins_meet_and_others_get_a_reply(spark, block):
    rng = random.Random(2)
    turns = []
    for i in range(0, 90):
        opening = "hot" if i % 3 == 0 else f"o{i % 7}" if i % 3 == 1 else f"own {i}"
        turns += [(i * 1000, 0, "user", opening), (i * 1000, 1, "assistant", f"a{i}"), (i * 1000, 2, "user", f"more {rng.random()}")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    convs = preferences.conversations(df)
    pairs = preferences.pair_up(convs, block)
    rows = pairs.collect()
    opening = {c: t for c, k, _, t in turns if k == 0}
    seen = [x for r in rows for x in (r["chosen_id"], r["rejected_id"]) if x is not None]
    assert sorted(seen) == sorted(opening) and all(opening[r["chosen_id"]] == opening[r["rejected_id"]] for r in rows if r["rejected_id"] is not None)
    alone = [opening[r["chosen_id"]] for r in rows if r["rejected_id"] is None]
    assert len(alone) == len(set(alone)) and all(r["reply_id"] != r["chosen_id"] for r in rows)
    done = {r["chosen_id"]: r for r in preferences.format_preferences(pairs, convs).collect()}
    for r in done.values():
        if r["reply_id"] is not None:
            assert r["n_prompt_turns"] == 1 and r["prompt"] == f"<|user|>\n{opening[r['chosen_id']]}<|end|>\n"
            assert r["rejected"] == f"<|assistant|>\na{r['reply_id'] // 1000}<|end|>\n" and r["rejected_mask"].endswith(":1")
    if block == 4096:
        assert all(r["n_prompt_turns"] == 1 for r in done.values())
