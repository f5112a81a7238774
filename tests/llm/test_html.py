import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import style_tree as T

DDL = "page_id bigint, url string, html string"


def text_of(page):
    return "\n".join(b.text for b in T.standing(T.parse(page)[1]))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple &#233;&eacute;", "plain & simple éé"),
        ("<p>a  b\n c<br>d<p>e<b>f</b>g", "a b c d\nefg"),
        ("<nav>menu</nav><article><h1>T</h1><p>x &lt;b&gt;</p><aside>s</aside><p>y</article><footer>f</footer>", "T\nx <b>\ny"),
        ("<script>var a='</p>';</script><style>p{}</style><p>x</p><!-- <p>no</p> --><form><p>f</p></form>", "x"),
        ("<main><div class='cookie-notice'>c</div><p>x</p><div id=comments><p>r</p></div></main><div class=sidebar>s</div>", "x"),
        ("<header>H</header><article><header><h1>T</h1><p>by</p></header><p>x</p></article>", "T\nx"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<div class='post-content'><p>x</p></div><div>y</div>", "x\ny"),
        ("<ul><li><a href=a>one</a><li><a href=b>two</a></ul>", "one\ntwo"),
        ("<p>x <button>b</button><select><option>o</select> y <span hidden>h</span>z</p>", "x y z"),
        ("<article class='comment'><p>r</p></article><div><p>x</p></div>", "x"),
        ("<body class='no-sidebar menu'><p>x</p></body>", "x"),
        ("<p title='a>b'>x</p><p hidden>h</p><p style='display: none'>n</p>", "x"),
        ("<div role=navigation>n</div><div role=main>x</div>", "x"),
        ("<p>a<script>1</script>b &nbsp; c</p>", "ab c"),
        ("<article><p>x</article></div></article><p>late", "x"),
        ("<p>a<!-- open", "a"),
        ("a < b and <3 c", "a < b and <3 c"),
        ("<title>t</title><p>x", "x"),
        ("<article><h1 class=header>T</h1><div class='article-header'><p>s</p></div><p class=notice>n</p><ul><li>l</ul></article>", "T\ns\nl"),
        ("<article><p>x</p><section id='post-comments'><p>r</p></section><div class='ad-slot'>a</div><figure><figcaption>c</figcaption></figure><pre>a\n  b</pre></article>", "x\nc\na b"),
        ("<div id=main><div class='related-posts'><p>r</p></div><blockquote>q</blockquote></div><div class='site-footer'>f</div>", "q"),
        ("<p>a&nbsp;b&#x2014;c&lt;d&gt; &notanentity; &amp;amp;</p>", "a b—c<d> ¬anentity; &amp;"),
    ],
)
def test_parse(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='content-sidebar-wrap'><main><p>x</p></main><aside>s</aside></div>", "x"),
        ("<div class='page-with-sidebar'><p>x</p><div class=sidebar>s</div></div>", "x"),
        ("<div class='content-with-sidebar'><p>x</p></div>", "x"),
        ("<div id='layout-sidebar-right'><h2>s</h2><article><p>x y z</p><div class='ad-slot'>a</div></article></div><p>t</p>", "x y z"),
        ("<div class='content-sidebar-wrap' role=main><p>x</p></div><p>t</p>", "x"),
        ("<div class='site-header-wrap'><div role=main><p>x</p><div class='share-bar'>s</div></div></div>", "x"),
        ("<main><h1>T</h1><div class='content-sidebar-wrap'><article><p>x y z</p></article></div></main>", "T\nx y z"),
        ("<div class='related-posts'><article><p>teaser</p></article></div><article><p>the whole story</p></article>", "the whole story"),
        ("<div class='sidebar-box'><article><p>teaser</p></article></div><div><p>the whole story</p></div>", "the whole story"),
        ("<div class='sidebar'><main><p>s</p></main></div><p>x</p>", "x"),
        ("<div class='ad-slot'><p>a</p></div><div class='post-comments'><p>r</p></div><p>x</p>", "x"),
    ],
)
def test_a_part_of_a_name_drops_no_article(page, want):
    assert text_of(page) == want


def site(spark, hosts=2, per_host=30):
    rows = []
    for h in range(hosts):
        for i in range(per_host):
            body = f"<div><p>Sign up to our letter</p></div><div class=c{i}><p>Story {h} {i} begins</p><p>and it goes on {i * 7} {'with more words ' * 9}</p></div><div>Part of the Example group</div>"
            rows.append((100 * h + i, f"https://host{h}.example/{i}", f"<html><body>{body}</body></html>"))
    rows.append((900, "https://alone.example/x", "<p>Sign up to our letter</p><p>Only page</p>"))
    rows.append((901, None, None))
    rows.append((901, None, None))
    rows.append((None, "nonsense", "<p>x</p>"))
    return spark.createDataFrame(rows, DDL).withColumns({"text": F.lit("t"), "ref": F.lit(1), "key": F.lit(2)}).repartition(3)


@pytest.mark.parametrize("limit", [T.DECISIONS, -1])
@pytest.mark.parametrize("per_host", [10, 19, 21, 30])
def test_style_tree_removes_what_a_site_repeats(spark, limit, per_host):
    table = site(spark, per_host=per_host)
    got = {}
    for r in T.extract_text(table, limit=limit).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for h in range(2):
        for i in range(per_host):
            assert got[100 * h + i] == [f"Story {h} {i} begins\nand it goes on {i * 7} {'with more words ' * 9}".strip()]
    assert got[900] == ["Sign up to our letter\nOnly page"] and got[901] == ["", ""] and got[None] == ["x"]
    assert sum(map(len, got.values())) == table.count()


def extracted(spark, rows, **options):
    return {r["page_id"]: r["text"] for r in T.extract_text(spark.createDataFrame(rows, DDL), **options).collect()}


def rotating(n, seed=5):
    """Pages of one template without any telling name: links, an advert that rotates, the story, a line below it."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeinorstl"), size=4)) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(words, size=k))
    adverts, rows, want = [say(6) for _ in range(7)], [], []
    for i in range(n):
        parts = [say(int(rng.integers(20, 60))) for _ in range(int(rng.integers(3, 12)))]
        links = "".join(f"<li><a href=/{k}>{w}</a>" for k, w in enumerate(rng.choice(words, size=5)))
        story = f"<h1>{say(4)}</h1>" + "".join(f"<p>{p}</p>" for p in parts)
        page = f"<body><div class=x><ul>{links}</ul></div><div class=y>{rng.choice(adverts)}</div><div class=z>{story}</div><div class=w>&copy; {say(3)}</div>"
        rows.append((i, "http://h.example/", page))
        want.append("\n".join([story[4 : story.index("</h1>")], *parts]))
    return rows, want


@pytest.mark.parametrize("n", [12, 60])
def test_the_tree_alone_cuts_slots_of_a_template(spark, n):
    rows, want = rotating(n)
    got = extracted(spark, rows, by_name=False)
    assert [got[i] for i in range(n)] == want


def brute(pages, by_name):
    """The style tree in plain Python over all pages at once; None keys stand for nothing."""
    parsed = [(T.host_of(url), *T.parse(html, by_name)) for _, url, html in pages]
    seen, style, content, mass, size, texts = set(), defaultdict(Counter), defaultdict(Counter), Counter(), Counter(), Counter()

    def branch(n, blocks):
        return tuple(b.text for b in blocks[n.first : n.last])

    for host, nodes, blocks in parsed:
        whole = sum(len(b.text) for b in blocks)
        held, bulk = 0, []
        for b in sorted(blocks, key=lambda b: (-len(b.text), T._hash(b.text))):
            if held < T.BULK * whole:
                bulk.append(b.text)
                held += len(b.text)
        if (host, tuple(sorted(bulk))) in seen:
            continue
        seen.add((host, tuple(sorted(bulk))))
        found = defaultdict(list)
        for n in nodes:
            if branch(n, blocks):
                found[host, n.path].append(n)
        for key, ns in found.items():
            style[key][frozenset(n.style for n in ns)] += 1
            content[key][tuple(branch(n, blocks) for n in ns)] += 1
            mass[key] += sum(len(t) for n in ns for t in branch(n, blocks))
            size[key] += whole
        texts.update({(host, b.node.path, b.text) for b in blocks})

    def entropy(counts):
        m = sum(counts.values())
        return -sum(c / m * math.log(c / m) for c in counts.values())

    out = []
    for host, nodes, blocks in parsed:
        gone, free, left = {}, {}, []
        for n in nodes:
            key, up = (host, n.path), n.up.place if n.up else None
            m = sum(style[key].values())
            repeated = slot = False
            if m:
                c = entropy(content[key]) / math.log(m) if m > 1 else 1.0
                repeated = (m * c + T.PRIOR) / (m + T.PRIOR) < T.LEAST
                slot = (m * c * mass[key] / size[key] + T.PRIOR) / (m + T.PRIOR) < T.LEAST
            within = free.get(up, False)
            gone[n.place] = gone.get(up, False) or repeated or (slot and not within and not n.main)
            free[n.place] = within or n.main or (m > 0 and entropy(style[key]) / math.log(2) >= T.FREE_FORM)
        for b in blocks:
            m = sum(style[host, b.node.path].values())
            if not gone[b.node.place] and texts[host, b.node.path, b.text] < T.NEARLY_ALL * (m + 1):
                left.append(b)
        out.append("\n".join(b.text for b in T.standing(left)))
    return out


def random_site(seed):
    """Pages of a few hosts that share templates, slots, texts and whole pages at random; no two pages share a bulk only."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeinorst"), size=3)) for _ in range(60)]
    say = lambda k: " ".join(rng.choice(words, size=k))
    names = ["", "class=menu", "class=story", "class=a1", "id=main", "class='post-comments'", "hidden"]
    rows = []
    for h in range(4):
        slots = [(rng.choice(["div", "nav", "article", "section", "p", "ul"]), rng.choice(names), int(rng.integers(0, 4))) for _ in range(5)]
        fixed = [say(6) for _ in range(3)]
        for i in range(int(rng.integers(1, 40))):
            if rows and rng.random() < 0.15:
                rows.append((len(rows), f"http://h{h}.example/", rows[int(rng.integers(len(rows)))][2]))
                continue
            page = ""
            for tag, name, kind in slots:
                inner = [fixed[0], fixed[int(rng.integers(3))], say(int(rng.integers(1, 40))), "".join(f"<p>{say(8)}</p>" for _ in range(int(rng.integers(1, 9))))][kind]
                page += f"<{tag} {name}>{inner}</{tag}>" if rng.random() < 0.95 else ""
            rows.append((len(rows), f"http://h{h}.example/", page))
    return rows


@pytest.mark.parametrize("by_name", [True, False])
@pytest.mark.parametrize("seed", range(4))
def test_extraction_against_brute_force(spark, seed, by_name):
    rows = random_site(seed)
    want = brute(rows, by_name)
    for limit in (T.DECISIONS, -1) if seed == 0 else (T.DECISIONS,):
        got = extracted(spark, rows, by_name=by_name, limit=limit)
        assert [got[i] for i in range(len(rows))] == want
    if not by_name:  # the tree removed something
        assert any(t != "\n".join(b.text for b in T.parse(r[2], False)[1]) for t, r in zip(want, rows, strict=True))


def test_repeated_articles_stay(spark):
    same = "<article><h1>One</h1><p>Same article</p></article>"
    rows = [(i, "http://h.example/", same if i % 2 else f"<article><p>Other {i}</p></article>") for i in range(60)]
    got = extracted(spark, rows)
    assert all(got[i] == ("One\nSame article" if i % 2 else f"Other {i}") for i in range(60))


def test_copies_of_a_page_count_once(spark):
    copy = "<article><h1>One</h1><p>Same article that is longer</p></article>"
    rows = [(i, "http://three.example/", "<p>Copied text</p>" if i else "<p>Other text</p>") for i in range(3)]
    rows += [(100 + i, "http://copies.example/", copy + f"<footer>{i}</footer>") for i in range(40)]
    rows += [(200 + i, "http://nearly.example/", copy if i else "<article><p>Other</p></article>") for i in range(40)]
    rows += [(300 + i, "http://plain.example/", "<p>Copied text</p><p>and more</p>") for i in range(40)]
    got = extracted(spark, rows)
    assert [got[i] for i in range(3)] == ["Other text", "Copied text", "Copied text"]
    assert {got[100 + i] for i in range(40)} == {"One\nSame article that is longer"}
    assert [got[200 + i] for i in range(40)] == ["Other"] + ["One\nSame article that is longer"] * 39
    assert {got[300 + i] for i in range(40)} == {"Copied text\nand more"}


@pytest.mark.parametrize("mark", ["div", "article"])
def test_the_share_of_repeats_does_not_fall_with_the_host(spark, mark):
    def text_of_page(i, n):
        return f"{'Own ' * 80}{i}" + ("\nIn four of five" if i % 5 else "") + ("\nIn nearly all" if i < n - 1 else "")

    rows = [(1000 * n + i, f"http://h{n}.example/", f"<{mark}>" + "".join(f"<p>{t}</p>" for t in text_of_page(i, n).split("\n")) + f"</{mark}>") for n in (20, 400) for i in range(n)]
    got = extracted(spark, rows)
    for n in (20, 400):
        assert [got[1000 * n + i] for i in range(n)] == [text_of_page(i, n).replace("\nIn nearly all", "") for i in range(n)]


@pytest.mark.parametrize("limit", [T.DECISIONS, -1])
def test_a_shared_text_takes_no_unique_ones_with_it(spark, limit):
    own = {i: [f"Paragraph {k} of {i}" for k in range(10)] for i in range(12)}
    rows = [(i, "http://h.example/", "<div>" + "".join(f"<p>{t}</p>" for t in [*own[i], "Shared by all"]) + "</div>") for i in own]
    got = extracted(spark, rows, limit=limit)
    assert got == {i: "\n".join(texts) for i, texts in own.items()}


def test_importance_follows_entropy(spark):
    rows = [(i, "http://h.example/", f"<p>own words of page {i} {'and more ' * 40}</p><h2>{'half' if i % 2 else 'rest'}</h2><h3>all</h3>" + "<h4>x</h4>" * (i % 4)) for i in range(16)]
    got = {r["node"]: r for r in T.importances(spark.createDataFrame(rows, DDL)).collect()}

    def node(*path):
        key = 0
        for tag in ("html", *path):
            key = T._hash(tag, key)
        return got[T._pair(T._hash("h.example"), key)]

    assert node("h3")["content"] == pytest.approx(0) and node("p")["content"] == pytest.approx(1)
    assert node("h2")["content"] == pytest.approx(math.log(2) / math.log(16))
    assert node()["presentation"] == pytest.approx(2) and node("p")["presentation"] == 0 and node()["pages"] == 16
    assert node()["share"] == 1 and 0.9 < node("p")["share"] < 1
    assert node("h4")["pages"] == 12 and node("h4")["content"] == pytest.approx(math.log(3) / math.log(12))


def test_deep_and_long_pages(spark):
    deep = "<div>" * 100_000 + "x" + "</div>" * 100_000
    long_ = "<p>" + "word " * 400_000 + "</p>"
    got = extracted(spark, [(1, "http://d/", deep), (2, "http://d/", long_), (3, "http://d/", "<b>" * 100_000 + "y"), (4, "http://d/", "<p>" * 50_000 + "z")])
    assert got == {1: "x", 2: ("word " * 400_000).strip(), 3: "y", 4: "z"}


def test_style_tree_empty(spark):
    assert T.extract_text(spark.createDataFrame([], DDL)).count() == 0
    assert T.extract_text(spark.createDataFrame([], DDL), limit=-1).count() == 0


def test_hosts():
    assert [T.host_of(u) for u in ("https://A.b:80/x?y", "http://u@c.d?q", "e.f/g", "", None)] == ["a.b:80", "c.d", "e.f", "", ""]
