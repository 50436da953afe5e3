"""Conversation repair, template removal and whitening against brute force, with nulls, ties, repeats, clashes and empty tables."""

import hashlib
import html as references
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.llm import conversations, queries, templates, whitening

SOLID = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?\Z")


def _cheapest(turns):
    """All edits with at most two insertions; turns as (must go, truncated, initial)."""
    best = None

    def go(i, roles, cost, audit, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(turns) and GOOD.match(roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserts < 2:
            for r in "ua":
                go(i, roles + r, cost + 5, audit + "I", inserts + 1)
        if i < len(turns):
            must, truncated, initial = turns[i]
            go(i + 1, roles, cost + 2, audit + "D", inserts)
            if not must:
                for r in "ua":
                    go(i + 1, roles + r, cost + 1 + 5 * truncated, audit + "R", inserts)
                go(i + 1, roles + (initial or "?"), cost + 5 * truncated, audit + "K", inserts)

    go(0, "", 0, "", 0)
    return best


def _contract(rows):
    """The contract's rows for (conv, turn, role, text) tuples."""
    shown = lambda v: " " if v is None else str(v)
    out = {}
    by = {}
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        role, text = shown(role), shown(text)
        fault = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, facts, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in kept:
            solid = SOLID.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            facts.append((fault in ("blank", "duplicate"), fault == "truncated", role[:1]))
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit = _cheapest(facts)
        said, state, i = [], "", 0
        for edit in audit:
            following = "assistant" if state == "u" else "user"
            if edit == "I":
                said.append(f"{following}:")
                state = following[0]
                continue
            _, role, text = kept[i]
            i += 1
            if edit != "D":
                role = role if edit == "K" else following
                said.append(f"{role}:{text}")
                state = role[0]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(kept)]
        out[conv] = dict(
            counts,
            gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            illegal=sum(p not in ("su", "ua", "au") for p in pairs),
            cost=cost,
            audit=audit,
            repaired_sha256=hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def _repaired(turns):
    damaged = conversations.damage(turns)
    report = conversations.repair(damaged, gone="gone")
    hashed = conversations.digests(damaged, report, gone="gone")
    rows = report.alias("r").join(hashed.alias("h"), F.col("r.conv_id").eqNullSafe(F.col("h.conv_id"))).select("r.*", "repaired_sha256").collect()
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in rows}, len(rows)


def test_repair_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = ["Yes.", "No!", "Why?", "cut of", "", " \t", None, "Same. ", "Fine.\n", "…", "é.", "a. "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "supervisor", "User"]
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(int(rng.integers(1, 7))):
            at = None if rng.random() < 0.05 else int(turn + (rng.random() < 0.1) * 3)
            rows.append((conv, at, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]))
    rows += rows[:20]  # repeated rows
    table = spark.createDataFrame([(*r, "x", 1, b"k", True) for r in rows], "conv_id long, turn long, role string, text string, conv string, head int, digest binary, gone boolean").repartition(5)
    got, n = _repaired(table)
    want = _contract(rows)
    assert n == len(want) and got == want
    assert _repaired(table.limit(0)) == ({}, 0)


def test_repair_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: r.asDict() for r in queries.QUERIES["op11_conversation_repair"](spark, sf).collect()}
    want = _contract(rows)
    assert set(got) == set(want)
    for conv, w in want.items():
        assert {k: got[conv][k] for k in w} == w


def test_repaired_turns_are_right(spark, sf):
    damaged = conversations.damage(spark.read.parquet(f"{sf}/conversations.parquet"))
    report = conversations.repair(damaged, gone="gone")
    by = {}
    for r in conversations.repaired(damaged, report, gone="gone").orderBy("conv_id", "position").collect():
        by.setdefault(r.conv_id, []).append(r.role[0])
    assert by and all(GOOD.match("".join(v)) for v in by.values())


def test_long_conversations_by_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    cases = ["".join(rng.choice(list("suauaSUAxX-"), rng.integers(0, 40))) for _ in range(150)]
    whole = [conversations.cheapest(c) for c in cases]
    monkeypatch.setattr(conversations, "BLOCK", 1)
    for part in (1, 4, 7):
        monkeypatch.setattr(conversations, "PART", part)
        assert [conversations.cheapest(c) for c in cases] == whole


def test_one_conversation_of_many_turns(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"Turn {k % 900}.") for k in range(20_000)]
    report = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert len(report) == 1 and report[0].duplicate > 10_000 and len(report[0].audit.replace("I", "")) == 20_000


def _article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(references.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<p>|</p>|<h1>|</h1>", inner))
    return "\n".join(b for b in blocks if b)


def test_templates_on_the_given_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.QUERIES["op12_template_removal"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, _article(pages[r.page_id].html), len(r.text))


def _soup(k, words="", shared=True):
    """A page without any telling name: only counts know its furniture."""
    top = "<div class='x1'><div><a href='/a'>Home</a> <a href='/b'>All</a></div></div>" if shared else f"<div class='x1'><div>Own {k}</div></div>"
    return f"<html><head><title>Story {k}</title></head><body>{top}<div class='x2'><h1>Story {k}</h1><div class='x3'>Told by {k}{words}<div class='x4'>Follow us daily</div></div><p>Common line</p></div><div id='x5'>All rights</div></body></html>"


def test_templates_by_counts_alone(spark):
    rows = [(k, f"https://one.example/{k}?x={k}", _soup(k)) for k in range(12)]
    rows += [(100 + k, f"https://two.example/{k}", _soup(7)) for k in range(12)]  # copies of one article
    rows += [(200 + k, f"//three.example:80/{k}", _soup(k, shared=False)) for k in range(12)]
    rows += [(300, "nowhere", _soup(1)), (301, None, _soup(1)), (302, "https://one.example/none", None), (303, "https://one.example/e", "")]
    table = spark.createDataFrame([(*r, "t", 5, 6, "h") for r in rows], "page_id long, url string, html string, text string, k1 int, dead int, host string")
    got = {r.page.page_id: r.text for r in templates.extract(table.repartition(4), furniture=False).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        assert got[k] == f"Story {k}\nTold by {k}\nCommon line"
        # a template stands beside different articles; copies of one do not make one
        assert got[100 + k] == "Home All\nStory 7\nTold by 7\nFollow us daily\nCommon line\nAll rights"
        assert got[200 + k] == f"Own {k}\nStory {k}\nTold by {k}\nCommon line"
    assert got[300] == got[301] == "Home All\nStory 1\nTold by 1\nFollow us daily\nCommon line\nAll rights"
    assert got[302] == got[303] == ""
    assert templates.extract(table.limit(0)).count() == 0


def test_counts_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [("h", int(s), int(t), bool(s % 2), int(a), bool(again)) for s, t, a, again in zip(rng.integers(0, 6, 400), rng.integers(0, 10, 400), rng.integers(0, 30, 400), rng.random(400) < 0.002, strict=True)]
    beside = {}
    for host, s, t, inside, a, again in rows:
        beside.setdefault((host, s, inside), {}).setdefault(t, [set(), False])
        beside[host, s, inside][t][0].add(a)
        beside[host, s, inside][t][1] |= again
    want = set()
    for (host, s, inside), held in beside.items():
        recur = sum(len(a) for a, _ in held.values() if len(a) >= 7)
        if recur >= 0.5 * sum(len(a) for a, _ in held.values()) and not (inside and any(x for _, x in held.values())):
            want |= {(host, s, inside, t) for t, (a, _) in held.items() if len(a) >= 7}
    table = spark.createDataFrame(rows, "host string, slot long, subtree long, inside boolean, article long, again boolean")
    assert {tuple(r) for r in templates.recurring(table, least=7).collect()} == want and want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a&amp;b &lt;c&gt; &#233; &eacute &am", "a&b <c> é é &am"),
        ("<script>var x='<p>no</p>'</script><p>yes</p><style>p{}</style>", "yes"),
        ("<p>one<p>two<b>bold<br>line</p>three", "one\ntwobold line\nthree"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc\nd\ne"),
        ("<div class='ad'>x</div><main><h1>T</h1>m<form>f</form><section id='comments'><article>c</article></section></main><footer>z", "T\nm"),
        ("<form><div><article><header><h1>T</h1></header><p title='a>b'>x</p></article></div></form>", "T\nx"),
        ("<header>site</header><nav role=x>menu</nav>plain <i>text</i><!-- c --> end<aside>s</aside>", "plain text end"),
        ("<article><p>a</p><div class='user-comments'><p>no</p></div><p>b</p></article><article><p>c</p></article>", "a\nb\nc"),
        ("</p></div><p>x</b></p><span class='cookie-notice'>We <b>use</b> cookies</span>", "x"),
        ("<p>" + "<div>" * 30000 + "deep" + "</div>" * 30000 + "<b>x<p>y" * 3000, "\n".join(["deep", "x", *["yx"] * 2999, "y"])),
    ],
)
def test_markup(spark, page, text):
    assert [r.text for r in templates.extract(spark.createDataFrame([(page, "http://h/x")], "html string, url string")).collect()] == [text]


def _whitened(x, rows):
    """Checks rows of whiten() against an eigendecomposition of the covariance of whole numbers x (a dict by key)."""
    keys = sorted(x)
    whole = np.array([x[k] for k in keys])
    n, sums = len(whole), whole.sum(axis=0)
    c = (n * whole - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = max(r.component for r in rows)
    got = np.full((n, k), np.nan)
    for r in rows:
        got[keys.index(r.row.vec_id), r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((n * whole - sums) ** 2).sum(axis=1)[keys.index(r.row.vec_id)])
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    assert len(rows) == n * k and not np.isnan(got).any()
    return got, c @ vectors[:, :k] / np.sqrt(values[:k]), values


def test_whitening_matches_eigenvectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = whitening.whiten(table).collect()
    x = {r.vec_id: np.floor(64 * np.array(r.embedding, float)).astype(int) + 1_000_000 for r in table.collect()}
    got, want, _ = _whitened(x, rows)
    assert got.shape[1] == 32
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(k, [float(v) for v in rng.integers(-9, 9, 5)]) for k in range(40)]
    good += good[:5]  # repeated rows count
    good = [(k, v) for k, (_, v) in enumerate(good)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, [1.0, 2.0]), (105, [1e300] * 5), (106, [])]
    table = spark.createDataFrame([(*r, "a", 3, 4) for r in good + odd], "vec_id long, embedding array<double>, row string, component int, n long").repartition(3)
    rows = whitening.whiten(table).collect()
    _, _, _ = _whitened({k: np.floor(64 * np.array(v)).astype(int) + 1_000_000 for k, v in good}, rows)
    assert {r.row.row for r in rows} == {"a"} and max(r.component for r in rows) == 5
    for few in (table.limit(0), table.where("vec_id = 0"), table.where("vec_id >= 100")):
        assert whitening.whiten(few).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0


def test_repeated_eigenvalues_are_all_found(spark):
    # three equal eigenvalues: a Krylov space of one start vector holds only one direction of them
    rows = [(i, [float(s * 2) if j == k else 0.0 for j in range(6)]) for i, (k, s) in enumerate(itertools.product((0, 1, 2, 4), (1, -1)))]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = {k: np.floor(64 * np.array(v)).astype(int) + 1_000_000 for k, v in rows}
    got, _, values = _whitened(x, found)
    assert got.shape[1] == 4 and np.allclose(values[:4], values[0])
    assert np.allclose(got.T @ got / len(rows), np.eye(4), atol=1e-9)
