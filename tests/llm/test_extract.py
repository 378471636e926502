from pyspark.sql import functions as F

from lanternlake.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";x(1<2);</script></head>
<body class="has-sidebar"><header><p>site header</p></header><nav><ul><li><a href="/x">one</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">buy</div><div class="cookie-notice">we use</div><article class=post><header><h1>Head &lt;1&gt;</h1></header>
<p><b>First   para<br>line &eacute; 2 < 3<p>Second&nbsp;one<aside>side</aside><p hidden>gone</p><p>Th<i>ir</i>d</p>
<form><input><p>mail</p></form><ul><li>a<li>b</ul><section id="comments"><article><p>I disagree</p></article></section>
<div class="share-buttons">tweet</div><noscript>js</noscript></article><footer>&copy; x</footer></body></html><scr"""


def test_blocks_by_markup():
    blocks = extract.blocks_of(PAGE)
    assert extract.main_text(blocks, [False] * len(blocks)).split("\n\n") == [
        "Head <1>", "First para line é 2 < 3", "Second one", "Third", "a", "b",
    ]


def test_odd_pages():
    for page, text in [
        ("", ""), ("plain text", "plain text"), ("a<b", "a"), ("1 < 2 &amp; 3 > 2", "1 < 2 & 3 > 2"), ("<p>x<!-- open", "x"),
        ("<script>all", ""), ("<p title='a>b'>q</p>", "q"), ("<p title=\"a>q</p>", "q"), ("</div></p>z", "z"),
        ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"), ("<article><p>k", "k"), ("<p>" + "w " * 200_000, ("w " * 200_000).strip()),
    ]:
        blocks = extract.blocks_of(page)
        assert "\n\n".join(b[3] for b in blocks) == text


def test_containers_by_name():
    page = (
        '<div class="top-bar-menu"><p>menu</p></div><div id="content" class="wide with-sidebar"><h2>T</h2><p>body</p>'
        '<div class="sidebar-left"><p>links</p></div><div id="comment-list"><p>me too</p></div></div><p>elsewhere</p>'
    )
    blocks = extract.blocks_of(page)
    assert extract.main_text(blocks, [False] * len(blocks)) == "T\n\nbody"


def test_broken_pages_take_linear_time():
    import time

    began = time.time()
    for page in ("<a" * 300_000, "<script " * 100_000, "<x-a>" * 60_000 + "t", "<p title='" * 60_000, "<!-- <p>" * 60_000, '"<' * 200_000, "</div>" * 100_000, "<div>" * 60_000 + "</p>" * 60_000,
        "<p><li>" + "<x-a>" * 60_000, "<div>" * 50_000 + "x" + "</div>" * 50_000):
        extract.blocks_of(page)
    assert time.time() - began < 20


def brute_cover(pages, run):
    streams = [[(w, b) for b, t in enumerate(p) for w in t.lower().split()] for p in pages]
    seen = {}
    for i, s in enumerate(streams):
        for k in range(len(s) - run + 1):
            seen.setdefault(tuple(w for w, _ in s[k : k + run]), set()).add(i)
    out = []
    for s, p in zip(streams, pages):
        hit = {k + d for k in range(len(s) - run + 1) if len(seen[tuple(w for w, _ in s[k : k + run])]) > 1 for d in range(run)}
        out.append([(sum(b == j for _, b in s), sum(k in hit for k, (_, b) in enumerate(s) if b == j)) for j in range(len(p))])
    return out


def test_repeated_runs_match_brute_force():
    import random

    rng = random.Random(3)
    pages = [[" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 4))] for _ in range(30)]
    pages += [["x y z " * 9], ["q r s t u v w", "q r s t u v w"], []]
    for run in (3, 6):
        assert extract.Streams([[t.encode() for t in p] for p in pages], run).repeated() == brute_cover(pages, run)


def test_names_with_other_words_need_a_second_sign():
    page = (
        '<article><p>one</p><div class="related-work"><p>earlier papers</p></div><div class="share-price-table"><p>12 points</p></div>'
        '<div class="related-work"><a href="x">only a link</a></div><div class="ad-slot"><p>buy</p></div>'
        "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <svg><title>icon</title><text>label</text></svg></p></article>"
    )
    blocks = extract.blocks_of(page)
    assert extract.main_text(blocks, [False] * len(blocks)) == "one\n\nearlier papers\n\n12 points\n\nso x=1 and label"
    assert extract.undecided(blocks) and extract.main_text(blocks, [True] * len(blocks)) == "one\n\nso x=1 and label"


def test_article_beside_a_teaser_and_deep_pages():
    blocks = extract.blocks_of('<div class="entry"><p>teaser</p></div><div><h1>Title</h1><p>the article itself is here</p></div>')
    assert extract.main_text(blocks, [False] * len(blocks)) == "teaser\n\nTitle\n\nthe article itself is here"
    deep = "<div>" * 2000 + "<nav>menu</nav><p>text</p>" + "</div>" * 2000 + "<footer>f</footer>"
    assert [b[3] for b in extract.blocks_of(deep)] == ["text"]
    assert extract.blocks_of("a\x00b")[0][3] == "a\x00b" == extract._unpack(extract._pack(extract.blocks_of("a\x00b")))[0][3]


def random_page(rng, host):
    """Html of a page, its blocks as (kind, hint, linked, text) and whether it has an article element."""
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(n))
    shared = lambda: f"all pages of {host} carry this line {rng.randint(0, 2)} alike"
    out, blocks = [], []
    article = rng.random() < 0.5

    def block(kind, hint=False):
        linked = rng.random() < 0.3
        text = shared() if rng.random() < 0.4 else words(rng.randint(1, 12))
        out.append(f'<p><a href="/x">{text}</a></p>' if linked else f"<p>{text}</p>")
        blocks.append((kind, hint, linked, text))

    for _ in range(rng.randint(0, 8)):
        choice = rng.choice(["nav", "ad", "plain", "named", "hint"] + ["article"] * article)
        tags = {"nav": "nav", "ad": "div", "plain": "div", "named": "div", "hint": "div", "article": "article"}[choice]
        names = {"ad": "ad-box", "named": "post-body", "hint": "related-studies"}.get(choice)
        out.append(f'<{tags} class="{names}">' if names else f"<{tags}>")
        for _ in range(rng.randint(1, 3)):
            if choice == "article" and rng.random() < 0.3:
                out.append('<div class="share-index">')
                block("article", True)
                out.append("</div>")
            else:
                block({"hint": "plain"}.get(choice, choice), choice == "hint")
        out.append(f"</{tags}>")
    return "".join(out), blocks


def brute_text(blocks, covered):
    visible = [b for b in blocks if b[0] != "nav"]
    flags = iter(covered)
    again = {i: next(flags) for i, b in enumerate(visible) if b[0] != "article" or b[1]}
    if any(b[0] == "article" for b in visible):
        keep = [b[3] for i, b in enumerate(visible) if b[0] == "article" and not (b[1] and (again[i] or b[2]))]
        return "\n\n".join(keep)
    menu = set()
    for i in range(len(visible)):
        j = i
        while j < len(visible) and visible[j][2]:
            j += 1
        if j - i >= 3:
            menu |= set(range(i, j))
    keep = [b for i, b in enumerate(visible) if b[0] != "ad" and not again[i] and i not in menu and not (b[1] and b[2])]
    named = [b[3] for b in keep if b[0] == "named"]
    plain = [b[3] for b in keep if b[0] != "named"]
    if named and len(" ".join(named).split()) >= len(" ".join(plain).split()):
        return "\n\n".join(named)
    return "\n\n".join(b[3] for b in keep)


def test_whole_extraction_matches_brute_force(spark):
    import random

    rng = random.Random(11)
    made = [(i, f"h{rng.randint(0, 2)}.net") for i in range(150)]
    pages = [(i, host, *random_page(rng, host)) for i, host in made]
    pages += [(1000 + p[0], *p[1:]) for p in pages[:20]]
    rows = [(i, f"http://{host}/{i}", page) for i, host, page, _ in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {}
    for host in {p[1] for p in pages}:
        mine = [p for p in pages if p[1] == host]
        streams = {tuple(b[3] for b in p[3] if b[0] != "nav" and (b[0] != "article" or b[1])) for p in mine}
        streams = sorted(streams)
        covers = {s: [hit >= 0.8 * n for n, hit in c] for s, c in zip(streams, brute_cover([list(s) for s in streams], 6))}
        for i, _, _, blocks in mine:
            stream = tuple(b[3] for b in blocks if b[0] != "nav" and (b[0] != "article" or b[1]))
            want[i] = brute_text(blocks, covers[stream])
    # The size of a shard changes nothing.
    for shard_bytes in (extract.SHARD_BYTES, 900):
        got = extract.extract(df, shard_bytes).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
        assert any(r.by_repetition for r in got)


def test_repeats_are_found_whatever_the_size_of_the_host(spark):
    line = "<div>only two pages of this host hold this very line</div>"
    own = lambda i: f"<div>page number {i} has this text of its own {i * 31}</div>"
    rows = [(i, "http://big.net/", own(i) + (line if i in (3, 1700) else "")) for i in range(2000)]
    rows += [(5000 + i, "http://small.net/", own(i) + (line if i in (3, 17) else "")) for i in range(20)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 4096).collect()
    assert len(got) == len(rows) and not any("only two" in r.text for r in got)
    assert all(r.text.startswith("page number") for r in got)


def test_contract(spark):
    shared = "<div>Home News Sport Weather and Travel pages</div>"
    own = lambda i: f"<div>unique text number {i} of page {i} about {i * 7}</div>"
    rows = [(i, f"http://h.net/{i}", shared + own(i) + "<div>all rights are reserved by the owner</div>") for i in range(30)]
    same = "<article><p>a passage that many pages of one host share in full</p></article>"
    rows += [(100 + i, "http://k.net/a", same) for i in range(250)]
    rows += [(900, None, None), (901, None, ""), (None, "x", "<p>lone"), (100, "http://k.net/a", same), (902, "http://long.net/", "<p>" + "w1 w2 " * 400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("blocks", F.lit(1))
    got = {r.page_id: r for r in extract.op7(df).collect()}
    assert extract.op7(df).count() == len(rows)
    for i in range(30):
        assert got[i].text == f"unique text number {i} of page {i} about {i * 7}" and got[i].n_chars == len(got[i].text)
    assert all(got[100 + i].text.startswith("a passage") for i in range(250))
    assert got[900].text == got[901].text == "" and got[None].text == "lone" and got[900].n_chars == 0
    assert got[902].text == ("w1 w2 " * 400_000).strip()
    assert extract.op7(df.limit(0)).count() == 0
