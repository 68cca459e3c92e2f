import random

from wavemill.llm import html

WORDS = [f"wort{i}" for i in range(80)]


def page(rng, body, marked):
    menu = "".join(f"<li><a href='/{w}'>{w}</a>" for w in rng.sample(WORDS, 4))
    note = "<p>Please read our rules before you post here.</p>"
    main = ("<article>", "</article>") if marked else ("<div class='story'>", "</div>")
    return (
        f"<!DOCTYPE html><html><head><title>x</title><script>if (a < b) document.write('<p>no</p>')</script><style>p{{}}</style></head><body>"
        f"<header><h2>{rng.choice(WORDS)}</h2></header><nav><ul>{menu}</ul></nav><!-- <p>gone</p> --><div class='ad box'>{rng.choice(WORDS)}</div>"
        f"{main[0]}{note}{body}<form><p>mail</p></form><div id=comments><p>{rng.choice(WORDS)} was here</p></div>{main[1]}<aside>more</aside><footer>&copy; us"
    )


def cases():
    rng = random.Random(4)
    pages, want = [], []
    for i in range(30):
        blocks = [" ".join(rng.choices(WORDS, k=rng.randint(3, 9))) for _ in range(rng.randint(1, 5))]
        body = f"<h1>{blocks[0]} &amp; &eacute;&#33;</h1>" + "".join(f"<p>{b.replace(' ', chr(10) + '  ', 1)}<b>bold<br>" for b in blocks[1:]) + f"<ul><li>{blocks[0][:9]}<li><i>t</i>wo {i}</ul>"
        want.append("\n".join([f"{blocks[0]} & é!", *[f"{b}bold" for b in blocks[1:]], blocks[0][:9].strip(), f"two {i}"]))
        pages.append(page(rng, body, marked=i % 2 == 0))
    return pages, want


def test_slots_without_template(spark):
    pages, want = cases()
    rows = [(i, f"https://{'aA'[i % 3 % 2]}.example.org/x", p, "clash") for i, p in enumerate(pages)]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for i, text in enumerate(want):
        assert got[i].text == text and got[i].n_chars == len(text), i


def test_a_single_page_keeps_its_notice_and_copies_are_no_evidence():
    pages, want = cases()
    assert html.extract(pages[:1]) == ["Please read our rules before you post here.\n" + want[0]]
    assert html.extract(pages[:1] * 50) == html.extract(pages[:1]) * 50


def test_simple_tree_matching_is_the_best_match():
    def tree(spec):
        node = html.Node(spec[0], spec[0], None, False)
        node.children = [tree(x) for x in spec[1:]]
        return node

    def brute(a, b):
        if a.label != b.label:
            return 0

        def best(xs, ys):
            if not xs or not ys:
                return 0
            return max(best(xs[1:], ys), best(xs, ys[1:]), brute(xs[0], ys[0]) + best(xs[1:], ys[1:]) if xs[0].label == ys[0].label else 0)

        return 1 + best(a.children, b.children)

    rng = random.Random(7)

    def deep(depth):
        return [rng.choice("ab"), *[deep(depth - 1) for _ in range(rng.randint(0, 4) if depth else 0)]]

    for _ in range(150):
        a, b = (tree(["r", *[deep(2) for _ in range(rng.randint(0, 4))]]) for _ in range(2))
        size, pairs = html.tree_match(a, b)
        assert size == brute(a, b) == 1 + sum(brute(x, y) for x, y in pairs)
        place = lambda some, one: next(i for i, z in enumerate(some) if z is one)
        at = sorted((place(a.children, x), place(b.children, y)) for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(at, at[1:]))
    for _ in range(200):  # leaves below the root, where equal ends are never worse
        a, b = (tree(["r", *[[rng.choice("abc")] for _ in range(rng.randint(0, 6))]]) for _ in range(2))
        assert html.tree_match(a, b)[0] == brute(a, b)


def test_a_node_without_partner_goes_beside_its_neighbours():
    pages = [f"<body><h1>t{i}</h1>{'<div class=box>Read the rules first.</div>' * (i > 0)}<p>one {i}<p>two {i}<div class=end>end {i}</div>" for i in range(12)]
    assert html.extract(pages) == [f"t{i}\none {i}\ntwo {i}\nend {i}" for i in range(12)]
    wrapper = html.Node("", "", None, False)
    for each in pages:
        html.align(wrapper, html.parse(each)[0])
    assert [x.tag for x in wrapper.children[0].children] == ["h1", "div", "p", "p", "div"]


def test_long_middles_have_the_best_match_too(monkeypatch):
    def flat(tags):
        node = html.Node("r", "r", None, False)
        node.children = [html.Node(t, t, node, False) for t in tags]
        return node

    rng = random.Random(8)
    a, b = flat(["x", *["q"] * 150, "m", *["r"] * 400, "z"]), flat(["y", "m", *["r"] * 400, *["s"] * 150, "w"])
    assert html.tree_match(a, b)[0] == 402 and len(html.tree_match(a, b)[1]) == 401
    trees = [[flat([rng.choice("abcd") for _ in range(rng.randint(0, 12))]) for _ in range(2)] for _ in range(200)]
    want = [html.tree_match(*pair)[0] for pair in trees]
    monkeypatch.setattr(html, "CELLS", 0)
    for pair, size in zip(trees, want, strict=True):
        got, pairs = html.tree_match(*pair)
        assert got == size == 1 + len(pairs) and all(x.label == y.label for x, y in pairs)


def test_optional_blocks_page_ids_and_the_first_page():
    """A constant notice that the first page lacks, and elements named by the page."""
    for outer in ("<div id='page-{i}' class='post-{i} entry'>", "<section>"):
        pages = [f"<body>{outer.format(i=i)}{'<section class=zork>Mind the gap.</section>' * (i > 0)}<p>one {i}<p>two {i}<div class=end>All rights kept</div>" for i in range(20)]
        assert html.extract(pages) == [f"one {i}\ntwo {i}" for i in range(20)]


def test_marks_are_whole_names_and_inline_elements_have_them_too():
    text = "<article><h1>t</h1><div class='social-history'>kept</div><div class='site-footer'>gone</div><p>a<span class='ad'> buy <b>now</b></span> b</p><p id='comment-form'>gone</p><div class='Ad-Box'>gone"
    assert html.extract([text]) == ["t\nkept\na b"]


def test_pages_of_any_length_are_evidence_alike(spark):
    """One long page does not take induction from the others."""
    rows = [(i, "https://h.example.org/x", f"<body><div>Read the rules.</div><p>page {i} {'x ' * (700_000 if i == 3 else 5)}") for i in range(12)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.startswith(f"page {r.page_id}") for r in got) and len(got) == 12


def test_unclosed_tags_and_quotes_take_linear_time():
    import time

    for piece in ("<a ", "<a \"'>", "<b>", "<!", "<x-a>", "</q", "<a href='", "<p class=\"x'>", "< ", "<script", "<i class=ad>"):
        begin = time.time()
        html.extract([piece * (1_000_000 // len(piece))])
        assert time.time() - begin < 20, piece
    assert html.extract(["<article><p>one<a title='x>two</a><p>three"]) == ["onetwo\nthree"]


def test_odd_pages(spark):
    odd = [None, "", "no tags at all", "<p>a<p>b", "<" * 50, "<div>" * 3000 + "deep", "<p title='>'>q</p", "<article><h1>t</h1><script>x", "a &nbsp; b&lt;c", "<p>" + "x " * 50000]
    rows = [(None if i == 3 else i, None if i % 2 else f"u{i}", x) for i, x in enumerate(odd)] + [(2, "u2", odd[2])]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert [texts[i] for i in (0, 1, 2, None, 5, 6, 7, 8)] == ["", "", "no tags at all", "a\nb", "deep", "q</p", "t", "a b<c"]
    assert texts[9] == ("x " * 50000).strip()
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def words(i, n, seed=0):
    rng = random.Random(1000 * seed + i)
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def test_a_teaser_article_beside_the_body():
    pages = [f"<nav>Home News</nav><div class='story'><h1>{words(i, 4)}</h1><p>{words(i, 50, 1)}</p></div><article><p>{words(i, 5, 2)}</p></article><footer>all rights</footer>" for i in range(10)]
    assert html.extract(pages) == [f"{words(i, 4)}\n{words(i, 50, 1)}" for i in range(10)]


def test_recurring_headings_between_slots_are_content():
    pages = [f"<article><h1>{words(i, 4)}</h1><h2>Ingredients</h2><p>{words(i, 20, 1)}</p><h2>Method</h2><p>{words(i, 30, 2)}</p><h3>Read more</h3><p>Sign up for our letters today</p></article>" for i in range(20)]
    assert html.extract(pages) == [f"{words(i, 4)}\nIngredients\n{words(i, 20, 1)}\nMethod\n{words(i, 30, 2)}" for i in range(20)]


def test_names_of_an_articles_own_parts_mark_nothing():
    for name in ("widget", "legal", "header"):
        pages = [f"<article><h1>{words(i, 4)}</h1><div class='{name}'>{words(i, 20, 1)}</div><div class='ad'>{words(i, 6, 3)}</div><p>{words(i, 30, 2)}</p></article><div class='{name}'>{words(i, 9, 4)}</div>" for i in range(3)]
        assert html.extract(pages) == [f"{words(i, 4)}\n{words(i, 20, 1)}\n{words(i, 30, 2)}" for i in range(3)], name


def test_induction_decides_where_no_name_does(monkeypatch):
    """Blocks without any telling name: what recurs goes, what varies stays; without evidence, everything stays."""
    pages = [f"<div class='x1'>Daily Gazette</div><div class='y'><p>{words(i, 4)}</p><p>{words(i, 40, 1)}</p></div><div class='z'>Printed since long ago</div>" for i in range(12)]
    want = [f"{words(i, 4)}\n{words(i, 40, 1)}" for i in range(12)]
    assert html.extract(pages) == want
    monkeypatch.setattr(html, "SHARE", 2.0)
    assert html.extract(pages) == [f"Daily Gazette\n{w}\nPrinted since long ago" for w in want]
