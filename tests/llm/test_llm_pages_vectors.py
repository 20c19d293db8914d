"""Pages, vectors and the pipeline on small inputs."""

import numpy as np
import pytest

import corpus_pipeline
from orthomark.llm import html_text, neighbours
from pyspark.sql import functions as F


def text_of(page):
    return html_text.main_text(html_text.read_page(page), np.zeros(10_000, bool))


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain  text\n here", "plain text here"),
    ("<html><head><title>t</title><style>p{}</style></head><body><article><h1>A</h1><p>b<b>c</b> d&amp;e</p></article><footer>f</footer>", "A bc d&e"),
    ("<nav>menu</nav><p>one</p><p>two</p><div class='cookie-banner'>no</div><form>x</form><aside>y</aside>", "one two"),
    ("<script>var a='</p><article>';</script><main><header>site</header><p>m</p><div class=comments>c</div></main>", "m"),
    ("<article>a<script>x</script>b<!-- c --><br>d<div class='ad'>buy</div><article class='comment'>r</article>e</article>", "a b d e"),
    ("<nav>never closed <article><p>x<p>y</article>", "x y"),
    ("<article>cut of", "cut of"), ("<article><p title='a>b'>q</p><p tit", "q"),
    ("<p>&nbsp;x&nbsp;&nbsp;y&#233;&am</p>", "x yé&am"),
])
def test_main_text(page, text):
    assert text_of(page) == text


def brute_repeated(pages):
    run, distinct = html_text.RUN, {tuple(map(tuple, p)) for p in pages}
    flat = [[t for block in d for t in block] for d in distinct]
    out = []
    for page in pages:
        tokens = [(t, n) for n, block in enumerate(page) for t in block]
        anywhere, inside = set(), set()
        for k in range(len(tokens) - run + 1):
            own = [t for t, _ in tokens[k:k + run]]
            if sum(any(f[j:j + run] == own for j in range(len(f))) for f in flat) >= html_text.PAGES:
                anywhere |= set(range(k, k + run))
                if tokens[k][1] == tokens[k + run - 1][1]:
                    inside |= set(range(k, k + run))
        open_blocks = {n for k, (_, n) in enumerate(tokens) if k not in anywhere}
        out.append([k in inside or n not in open_blocks for k, (_, n) in enumerate(tokens)])
    return out


def test_suffix_array():
    rng = np.random.default_rng(3)
    for top in (1, 2, 3, 30):
        pages = [[[f"t{v}" for v in rng.integers(0, top, rng.integers(0, 14))] for _ in range(rng.integers(0, 4))] for _ in range(12)]
        pages.append(list(pages[0]))
        assert [m.tolist() for m in html_text.repeated(pages)] == brute_repeated(pages)
    assert html_text.repeated([]) == []


def test_boilerplate_of_a_host(spark):
    """Without an article the repeated runs of a host go and the unique ones stay."""
    line = "follow us on all of our channels today"
    rows = [(k, f"https://h.example/{k}", f"<div>{line}</div><p>own words of page {k} number {k * 7}</p>", "x") for k in range(20)]
    rows += [(100, "https://other.example/", f"<div>{line}</div>", "x"), (101, None, None, "x"), (102, "https://h.example/e", "", "x"), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert all(by_id[k].text == f"own words of page {k} number {k * 7}" and by_id[k].n_repeated == 8 for k in range(20))
    assert by_id[100].text == line and by_id[101].text == by_id[102].text == "" and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.filter("false")).count() == 0


def test_boilerplate_is_counted_over_the_whole_host(spark, monkeypatch):
    """A notice on few pages of a host of many shards goes, as it does in a host of one; copies count once."""
    notice, twice = "please read the terms of this site before you go on", "only two different pages hold this line of words"
    rows = []
    for k in range(240):
        extra = f"<div>{notice}</div>" if k % 60 == 0 else f"<div>{twice}</div>" if k in (1, 2) else ""
        rows.append((k, f"https://h.example/{k}", f"{extra}<p>own{k} words{k} of{k} page{k}</p>"))
    rows += [(1000 + k, f"https://h.example/copy{k}", rows[1][2]) for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = {r.page_id: r for r in html_text.extract(pages).collect()}
    monkeypatch.setattr(html_text, "SHARD", 8)
    many = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert one == many and len(many) == len(rows)
    assert all(many[k].text == f"own{k} words{k} of{k} page{k}" for k in range(0, 240, 60))
    assert all(many[k].text.startswith(twice) for k in (1, 2, 1000, 1029))


@pytest.mark.parametrize("run", [4, html_text.RUN])
def test_run_codes_mark_like_the_suffix_array(monkeypatch, run):
    monkeypatch.setattr(html_text, "RUN", run)
    rng = np.random.default_rng(6)
    for top in (1, 2, 30):
        pages = [[[f"t{v}" for v in rng.integers(0, top, rng.integers(0, 3 * html_text.RUN))] for _ in range(rng.integers(0, 4))] for _ in range(12)]
        found = html_text.Runs(pages)
        distinct = {html_text.stream_code(p): c for p, c in zip(pages, found.of_pages())}
        codes, n = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
        assert [m.tolist() for m in html_text.repeated(pages)] == brute_repeated(pages)
        assert [m.tolist() for m in found.run_marks(codes[n >= html_text.PAGES])] == brute_repeated(pages)
    assert html_text.Runs([]).run_marks(np.zeros(0, np.int64)) == html_text.boilerplate([]) == []


def brute_whole_blocks(pages):
    """Tokens in whole blocks side by side, the fewest that have LEAST tokens from or up to a block."""
    pages = [[b for b in p if b] for p in pages]

    def spans(page):
        for k in range(len(page)):
            for part in ([page[k:e] for e in range(k + 1, len(page) + 1)], [page[s:k + 1] for s in range(k, -1, -1)]):
                long = [p for p in part if sum(map(len, p)) >= html_text.LEAST]
                if long:
                    at = k if part[0] == page[k:k + 1] and long[0] == page[k:k + len(long[0])] else k + 1 - len(long[0])
                    yield sum(long[0], []), at, at + len(long[0])

    distinct = {tuple(map(tuple, p)): p for p in pages}
    held = [{tuple(t) for t, _, _ in spans(p)} for p in distinct.values()]
    out = []
    for p in pages:
        marked = set()
        for t, a, b in spans(p):
            if sum(tuple(t) in h for h in held) >= html_text.enough(len(distinct)):
                marked |= set(range(a, b))
        out.append([n in marked for n, block in enumerate(p) for _ in block])
    return out


def test_whole_blocks():
    rng = np.random.default_rng(9)
    for top in (1, 2, 4):
        pages = [[[f"t{v}" for v in rng.integers(0, top, rng.choice([0, 1, 2, 3, 6, 8]))] for _ in range(rng.integers(0, 6))] for _ in range(14)]
        pages = [[b for b in p if b] for p in pages]
        assert [m.tolist() for m in html_text.boilerplate(pages)] == brute_whole_blocks(pages)


def test_common_phrases_stay(spark):
    """Six words that many pages share are not cut out of unique prose; repeats of few pages of a large host stay."""
    phrase, quoted = "at the end of the day it was", "to be or not to be that is the question"
    texts = [f"first{k} second{k} {phrase} third{k} fourth{k}" for k in range(400)]
    rows = [(k, f"https://h.example/{k}", f"<p>{t}</p>" + (f"<p>{quoted}</p>" if k < 3 else "")) for k, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {k: t + (f" {quoted}" if k < 3 else "") for k, t in enumerate(texts)}


def test_long_text_around_teasers(spark):
    """Long unique text outside of short articles stays, repeated and short text there goes."""
    own = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(6)]
    line = " ".join(f"line{j}" for j in range(30))
    teaser = "<article>one teaser</article><div>short note</div>"
    rows = [(k, f"https://h.example/{k}", f"<div>{line}</div>{teaser}<div>{t}</div>") for k, t in enumerate(own)]
    rows += [(10, "https://h.example/m", f"<main><div>{own[0]} m</div><article>one teaser</article></main>"),
             (11, "https://h.example/a", f"<article>{own[1]} a</article><div>{own[2][:200]} b</div>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"one teaser {t}" for k, t in enumerate(own))
    assert got[10] == f"{own[0]} m one teaser" and got[11] == f"{own[1]} a"


def test_nearest_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 24)).astype(np.float32)
    vectors[50:90] = vectors[50]  # ties
    rows = [(int(k), [float(v) for v in vectors[k]], "x") for k in range(300)]
    rows += [(400, None, "x"), (420, [0.0] * 24, "x"), (440, [None] + [1.0] * 23, "x"), (460, [float("nan")] + [1.0] * 23, "x"), (480, [1.0, 2.0], "x"), (500, [], "x"),
             (None, [1.0] * 24, "x"), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        x = vectors.astype(np.float64)
        scores = np.zeros(300)
        for d in range(24):
            scores += x[:, d] * x[q, d]
        expected = sorted((-s, k) for k, s in enumerate(scores) if k != q)[:20]
        assert found == [(k, -s) for s, k in expected]
    few = neighbours.nearest(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]
    assert neighbours.nearest(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_of_any_size(spark, monkeypatch):
    """Huge, tiny and nearly equal vectors: nothing overflows unseen, and rounding loses no neighbour."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 8))
    x[:60] *= 1e200
    x[60:90] *= 1e-310
    x[90:160] = x[90] * 1e6 + rng.normal(size=(70, 8)) * 1e-8
    x[3] = [1e200, 1e200, 0, 0, 0, 0, 0, 0]
    x[7] = [1e200, -1e200, 0, 0, 0, 0, 0, 0]
    scores = np.array([neighbours.exact(np.repeat(x[k:k + 1], len(x), axis=0), x) for k in range(0, 240, 20)])
    monkeypatch.setattr(neighbours, "VALUES", 100)  # tiles of twelve vectors
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=10).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for row, query in zip(scores, range(0, 240, 20)):
        best = sorted((-row[k], k) for k in range(240) if k != query)[:10]
        assert found[query] == [(k, -v) for v, k in best]


def test_error_bound_holds():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(40, 70)) * rng.lognormal(size=(40, 1)), rng.normal(size=(50, 70))
    (qx, sx, nx, rx), (qy, sy, _, ry) = neighbours.quantise(x), neighbours.quantise(y)
    rounded = (qx.astype(float) @ qy.astype(float).T) * sx[:, None] * sy
    bound = rx[:, None] * np.linalg.norm(y, axis=1) + nx[:, None] * ry
    assert (np.abs(rounded - x @ y.T) <= bound + 1e-12).all()


def test_pipeline_stages(spark, tmp_path):
    """Each stage on the smallest data: columns stay, decisions take effect, clean rows survive."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and (docs.columns == columns or number == 4), name
        if number in (3, 4):
            assert kept == ids
        ids = kept
    rows = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("first")).collect()
    assert all(r.n <= 2048 and r.first == 0 for r in rows)
    assert len(rows) <= -(-sum(r.n for r in rows) // 2048) + 1


def test_pipeline_on_empty_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
