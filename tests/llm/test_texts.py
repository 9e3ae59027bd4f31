"""Mixing, fingerprints, leaks, near-duplicates and page texts."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillgauge.llm import decontaminate, fingerprint, html, mixing, neardup
from quillgauge.llm.oracle import ORACLE


# --- mixing -----------------------------------------------------------------------------


def water_level(sizes, weights, total, caps):
    """Targets by filling up step by step."""
    left, free, made = total, set(sizes), {}
    while free:
        share = left / sum(weights[s] for s in free)
        full = {s for s in free if share * weights[s] > caps[s]}
        if not full:
            return made | {s: share * weights[s] for s in free}
        for s in full:
            made[s] = caps[s]
            left -= caps[s]
        free -= full
    return made


def test_mix_on_edge_cases(spark, edge, nothing):
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count() and mixing.mix(nothing).collect() == []
    sizes = Counter()
    for r in rows:
        assert r["size"] == len([w for w in re.split(r"[ \t-\r]+", r["text"] or "") if w])
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_level(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), {s: 2 * n for s, n in sizes.items()})
    for r in rows:
        assert math.isclose(r["target"], want[r["source"]], abs_tol=1e-6) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])


def test_mix_comes_near_its_targets_and_agrees_with_itself(spark, documents):
    first, again = (sorted((r["doc_id"], r["taken"]) for r in mixing.mix(d).collect()) for d in (documents, documents.repartition(7)))
    assert first == again
    rows = mixing.mix(documents).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_odds_change_who_is_taken(spark):
    rows = [(k, f"{'w ' * 10}", "a" if k % 2 else "b", 100.0 if k < 400 else 0.01) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, q DOUBLE")
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, weights=(1, 1), share=0.5, odds="q").collect()}
    assert sum(taken.values()) == 400 and sum(taken[k] for k in range(400)) > 360


def test_mix_equals_its_sql_with_long_source_lists(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randrange(60), rng.choice(["x", "y", "z", None, "q" * rng.randrange(1, 5)])) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE['op3_pareto_mix']})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in mixing.mix(docs).collect()) == want


# --- fingerprints -----------------------------------------------------------------------


def jaccard(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


@pytest.mark.parametrize("rows", [3, 4000])
def test_fingerprints(spark, edge, documents, rows):
    data = [(r["doc_id"], r["text"]) for r in edge.collect() if r["doc_id"] != 5] + [(r["doc_id"] + 100, r["text"]) for r in documents.limit(60).collect()]
    got = fingerprint.digest(spark.createDataFrame(data, "doc_id BIGINT, text STRING"), rows=rows).collect()
    assert len(got) == len(data)
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    errors, prints = [], {}
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        row = next(r for r in by[i] if r["edited_sha256"] == sha)
        assert row["n_chars"] == len(text) and prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        words, edit, next_words = (Counter(w for w in re.split(r"[ \t-\r]+", t) if w) for t in (text, edited, after))
        if words:
            errors += [row["near_edited"] - jaccard(words, edit), row["near_next"] - jaccard(words, next_words)]
    assert np.sqrt(np.mean(np.square(errors))) < 0.12 and abs(np.mean(errors)) < 0.03


def test_fingerprints_shuffle_the_texts_once(documents):
    plan = fingerprint.digest(documents)._jdf.queryExecution().executedPlan().toString()
    # The rows of the ranges, and the first row of each range.
    assert plan.count("Exchange hashpartitioning(range") == 2


def test_fingerprints_of_no_rows(nothing):
    assert fingerprint.digest(nothing).collect() == []


def test_fingerprint_tasks_hold_one_range_each(spark):
    # A task's words fill its memory, so Spark must not merge ranges into few tasks.
    docs = spark.range(600).selectExpr("id AS doc_id", "concat_ws(' ', id, id + 1, id + 2) AS text")
    got = fingerprint.digest(docs, rows=20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(range#\d+, 30\), REPARTITION_BY_NUM", plan)
    assert got.count() == 600


# --- leaks ------------------------------------------------------------------------------


def test_subsequence_length():
    rng = random.Random(4)
    for _ in range(60):
        a, b = (["abcd"[rng.randrange(4)] for _ in range(rng.randrange(1, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_length(a, b) == table[-1][-1]


def test_leaks_are_found_and_clean_documents_left(spark, documents, sf, edge, nothing):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    words = {i: re.findall(r"\w+", t.lower()) for i, t in texts.items()}
    rng, planted, rows = random.Random(6), {}, []
    for n, (item, text) in enumerate(bench):
        host, own = words[sorted(words)[n]], re.findall(r"\w+", text.lower())
        paraphrase = [w for w in own if n % 2 or rng.random() > 0.15]
        planted[10_000 + n] = item
        rows.append((10_000 + n, " ".join(host[:n * 3] + paraphrase + host[n * 3:])))
    rows += list(texts.items())
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(
        spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), spark.createDataFrame([*bench, (900, None), (901, " "), (None, "x y z")], "item_id BIGINT, text STRING")).collect()}
    assert len({p for p in planted.items()} & found) >= 0.95 * len(planted)
    exact = set()
    for item, text in bench:
        own = " ".join(re.findall(r"\w+", text.lower()))
        exact |= {(i, item) for i, w in words.items() if f" {own} " in f" {' '.join(w)} "}
    assert exact <= found
    for doc, item in found - set(planted.items()) - exact:
        if doc < 10_000:
            own = re.findall(r"\w+", dict(bench)[item].lower())
            assert decontaminate.common_length(own, words[doc]) >= 0.55 * len(own)
    benchmark = spark.createDataFrame(bench, "item_id BIGINT, text STRING")
    assert decontaminate.clean(edge, benchmark).count() == edge.count()
    assert decontaminate.leaks(nothing, benchmark).collect() == [] and decontaminate.leaks(edge, benchmark.limit(0)).collect() == []


def planted_items(documents, number, longest, keep):
    """Items cut from documents, and hosts with a paraphrase of each at a random place."""
    rng = random.Random(12)
    words = [w for w in (re.findall(r"\w+", (r["text"] or "").lower()) for r in documents.orderBy("doc_id").collect()) if len(w) > 80]
    sources, hosts, items, rows = words[: len(words) // 2], words[len(words) // 2 :], [], []
    for n in range(number):
        own = rng.choice(sources)
        size = rng.randrange(15, longest)
        start = rng.randrange(len(own) - size)
        items.append((n, " ".join(own[start : start + size])))
        if n % 8 == 0:
            host, at = rng.choice(hosts), rng.randrange(60)
            rows.append((n, " ".join([*host[:at], *[w for w in own[start : start + size] if n % 16 or rng.random() < keep], *host[at:]])))
    return items, rows


def recall(spark, items, rows):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(
        spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")).collect()}
    return lambda kept: np.mean([(n, n) in found for n, _ in rows if kept(n)])


def test_leaks_of_every_block_are_found(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 1_600)
    share = recall(spark, *planted_items(documents, 3_200, 60, 0.9))
    first, second = share(lambda n: n < 1_600), share(lambda n: n >= 1_600)
    assert min(first, second) >= 0.93, (first, second)


def test_short_and_shortened_items_are_found(spark, documents):
    share = recall(spark, *planted_items(documents, 3_200, 25, 0.85))
    whole, dropped = share(lambda n: n % 16), share(lambda n: n % 16 == 0)
    assert whole >= 0.99 and dropped >= 0.93, (whole, dropped)


# --- near-duplicates --------------------------------------------------------------------


def test_near_duplicates_match_brute_force(spark, documents):
    rng = random.Random(8)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(120)).split()
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(120), rng.randrange(4)):
            copy[at] = f"v{k}"
        rows.append((5000 + k, " ".join(copy)))
    rows += [(6000, None), (6001, ""), (6002, "short one"), (6003, "Short one")]
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()
    top = {i: i for i in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    for limit in (20_000, 25):
        got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs, shard_rows=limit).collect()}
        assert got == {i: find(i) for i in ids}


def test_near_duplicates_edge_cases(edge, nothing):
    kept = neardup.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "10", "2", "5", "6", "9", "None"]
    assert neardup.keep_one(nothing).collect() == []


# --- pages ------------------------------------------------------------------------------

PAGES = [
    ("<html><head><title>T</title><script>if (a<b) x('</p>')</script></head><body><nav><a href=/>Home</a></nav><article><h1>Head &amp;\n line</h1>"
     "<p>One <b>bold</b><br>two&nbsp;x<p>Three<aside>Side</aside><div class='comments'><p>Reader</p></div></article><footer>&copy; f</footer>", "Head & line\nOne bold two x\nThree"),
    ("<div class=menu><a href=a>Aa</a><a href=b>Bb</a></div><div id=content><p>First long paragraph of words.</p><form><input><p>Ask</p></form><p>Second one of words here.</p></div>"
     "<div class='cookie-notice'>Cookies</div>", "First long paragraph of words.\nSecond one of words here."),
    ("<main><ul><li>One<li>Two</ul><table><tr><td>a b<td>c</table><!-- <p>no</p> --><p title='a>b'>End &lt;x&gt; &#233;</p></main><p>Outside text", "One\nTwo\na b\nc\nEnd <x> é"),
    ("<article><p>Cut off here</p><p>and t", "Cut off here\nand t"), ("<article><p>Cut <b", "Cut"), ("", ""), (None, ""), ("<p></p><br>", ""), ("just text", "just text"),
    ("<article class=comment><p>Reader words only here</p></article><article><p>Real words</p></article>", "Real words"),
]


def test_pages(spark):
    pages = spark.createDataFrame([(k, "u", h, "old") for k, (h, _) in enumerate(PAGES)] + [(None, None, "<p>x</p>", "old"), (0, "u", PAGES[0][0], "old")], "page_id BIGINT, url STRING, html STRING, text STRING")
    weights = html.learn(pages)
    rows = html.main_text(pages, weights).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == len(PAGES) + 2
    for k, (_, want) in enumerate(PAGES):
        assert got[k]["text"] == want, k
        assert got[k]["n_chars"] == len(want)
    assert html.main_text(pages.limit(0), html.learn(pages.limit(0))).collect() == []


@pytest.mark.parametrize("page", [
    "<div class='layout with-sidebar'><article>{}</article></div>", "<div id=page class=has-comments><main>{}</main></div>", "<article class='post related'>{}</article>",
    "<main class=no-sidebar>{}</main>", "<form><div>{}</div></form>", "<article>{}<div class=social>Share</div></article>",
])
def test_marks_do_not_empty_a_page(page):
    inner = "<p>Some first words of it.</p><p class=notice>And a second paragraph.</p>"
    weights = html.Weights({}, {})
    want = "Some first words of it.\nAnd a second paragraph."
    assert html.extract(page.format(inner if "<form" not in page else inner.replace(" class=notice", "")), weights) == want
    assert html.extract("<div class=comments><p>Words</p></div><article><p>Text</p></article>", weights) == "Text"


def test_region_is_the_largest_sum():
    rng = random.Random(9)
    for _ in range(50):
        values = [rng.uniform(-2, 2) for _ in range(rng.randrange(1, 15))]
        a, b = html.best_region(values)
        best = max([0.0, *(sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1))])
        assert math.isclose(sum(values[a:b]), best, abs_tol=1e-9)


def test_pages_of_the_table(spark, sf):
    from quillgauge.llm.queries import QUERIES

    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op10_main_text"](spark, sf).collect()
    assert {r["page_id"] for r in rows} == source.keys()
    for r in rows:
        inner = re.sub(r"<[^>]*$", "", re.search(r"(?s)<article>(.*?)(</article>|$)", source[r["page_id"]])[1])
        parts = [" ".join(html.unescape(re.sub("</?b>|<br>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p)


ODD_TEXTS = ["Ünïcödé_𝒳 don't—stop “now” ΣΑΣ İi x\x1cy z　w ١٢ ² é́", None, "", " .,; \t\n", "one", "  Two, TWO two. ", "a b c d e f g " * 11, "k%d " * 24 % tuple(range(24))]


def test_words_are_cut_as_by_the_pattern():
    got = decontaminate.word_codes(ODD_TEXTS)
    assert [g.tolist() for g in got] == [[decontaminate.bucket(w, decontaminate.BUCKETS) for w in decontaminate.words_of(t)] for t in ODD_TEXTS]


@pytest.mark.parametrize("fit_steps", [2, 1024])
def test_space_is_fitted_on_every_passage(monkeypatch, documents, fit_steps):
    monkeypatch.setattr(decontaminate, "FIT_STEPS", fit_steps)
    texts = ODD_TEXTS + [r["text"] for r in documents.limit(40).collect()]
    rng = np.random.default_rng(0)
    idf, right = np.append(rng.random(decontaminate.BUCKETS), 0), rng.standard_normal((decontaminate.BUCKETS, 5))
    weighed = np.append(right * idf[:-1, None], np.zeros((1, 5)), axis=0)
    got, number = np.zeros((decontaminate.BUCKETS + 1, 5)), 0
    batch = pa.RecordBatch.from_pydict({"text": texts})
    for steps, roles in decontaminate.read_steps(decontaminate.step_rows([batch])):
        decontaminate.add_gram_of_steps(got, steps, roles, idf, weighed)
        number += (roles != decontaminate.SHARED).sum()
    groups = [g for c in decontaminate.word_codes(texts) if len(c) for g in decontaminate.windows(c)]
    assert np.allclose(got[:-1], decontaminate.gram_times(groups, idf[:-1], right)) and not got[-1].any()
    assert number == sum(-(-len(decontaminate.words_of(t)) // decontaminate.STEP) for t in texts)


def test_no_passage_is_left_out_of_the_fit(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k} other{k} text") for k in range(60)], "doc_id BIGINT, text STRING")
    idf, steps, number = decontaminate.background(docs)
    assert number == 60
    first = decontaminate.fit(idf, steps, number, [[np.array([1, 2, 3])]], fit_passages=5)
    # Each text has a word of its own in the space, however few passages the corpus counts for.
    assert all(np.abs(first.basis[decontaminate.word_codes([f"word{k}"])[0]]).max() > 0 for k in range(60))


def test_passages_of_many_pieces_at_once():
    rng = np.random.default_rng(4)
    space = decontaminate.Space(rng.standard_normal((decontaminate.BUCKETS, 7)).astype(np.float32))
    pieces = [rng.integers(0, decontaminate.BUCKETS, n).astype(np.int32) for n in (1, 12, 13, 24, 30, 36, 47, 48, 49, 60, 300)]
    for (got, piece, number), width in zip(space.passages(pieces), (decontaminate.WINDOW, decontaminate.WINDOW // 2), strict=True):
        want = []
        for k, codes in enumerate(pieces):
            last = max(-(-len(codes) // decontaminate.FINE) - width // decontaminate.FINE, 0)
            for n in range(last + 1):
                start = n * decontaminate.FINE
                want.append((k, n, decontaminate.unit(space.basis[codes[start : start + width]].sum(0, keepdims=True))[0]))
        assert [(k, n) for k, n, _ in want] == list(zip(piece.tolist(), number.tolist(), strict=True))
        assert np.allclose(got, [v for *_, v in want], atol=1e-5)


def test_words_in_common_bound_the_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(200):
        item, words = ([f"w{k}" for k in rng.integers(0, 12, rng.integers(1, 30))] for _ in range(2))
        kinds = np.unique([decontaminate.bucket(w, decontaminate.BUCKETS) for w in item], return_counts=True)
        assert decontaminate.most_common(kinds, decontaminate.word_codes([" ".join(words)])[0]) >= decontaminate.common_length(item, words)
    assert decontaminate.most_common(kinds, np.zeros(0, np.int32)) == 0


def test_symbols_are_blanked_whether_few_or_many():
    text = "a—b“c”d" + "".join(f"x{chr(k)}" for k in range(0x2190, 0x21C0))
    assert decontaminate.without_symbols(text) == decontaminate.SYMBOLS.sub(" ", text)
    assert decontaminate.without_symbols("é—é“x") == "é é x"
