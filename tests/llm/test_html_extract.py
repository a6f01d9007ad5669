import itertools
import json
import random
import re

from pyspark.sql import functions as F

from lakeloom.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li><li><a href='/b>c'>Other</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy &amp; win</div>
<article><h1>{title}</h1><p><b>{first}<br><p>{second}</p><ul><li>one<li>two</ul><div class="comments"><p>First comment</p></div></article>
<aside>Side</aside><form><input value="x">Sign up</form><footer>&copy; host</footer></body></html>"""


def wrapper_of(*sources):
    wrapper = None
    for source in sources:
        own = H._bare(H.pattern(H.parse(source)))
        wrapper = own if wrapper is None else H.align(wrapper, own)
    return json.loads(json.dumps(wrapper))


def text_of(source, *others):
    alone = not {H.page_of(H.parse(o)) for o in others} - {H.page_of(H.parse(source))}
    return H.read(H.parse(source), H.judge(wrapper_of(source, *others), 1 + len(others), alone))


def test_article_without_its_surroundings():
    page = PAGE.format(title="Head line", first="Some\n  <i>bold</i>ly &eacute;&#33; text", second="a &lt; b &amp;amp; c")
    assert text_of(page) == "Head line Some boldly é! text a < b &amp; c one two"


def test_unclosed_and_cut_pages():
    assert text_of("<nav><ul><li>menu<article><p>kept<p>too") == "kept too"
    assert text_of("<article><p>cut in the mid") == "cut in the mid"
    assert text_of("<article>a < b and <3 </nope> c</article>") == "a < b and <3 c"
    assert text_of("") == text_of(None) == text_of("<script>x") == ""


def test_constant_text_goes_without_an_article():
    make = "<html><body><div class=x><p>Site of things</p></div><div><p>{}</p><p>{}</p></div></body></html>"
    a, b = make.format("first text", "more"), make.format("second text", "others")
    assert text_of(a, b) == "first text more"


def test_copies_keep_their_article():
    page = PAGE.format(title="t", first="f", second="s")
    assert text_of(page, page, page) == text_of(page) == "t f s one two"


def test_near_copies_keep_what_they_share():
    pages = [f"<article><h1>Head</h1><p>{'same words ' * 30}</p><p>end {k}</p></article>" for k in range(12)]
    assert text_of(*pages) == f"Head {'same words ' * 30}end 0"


def test_constants_inside_an_article_go_where_many_pages_hold_them():
    pages = [f"<article><h1>Head {k}</h1><p>Tell your friends.</p><p>{f'text {k} ' * 9}</p></article>" for k in range(H.SUPPORT)]
    assert text_of(*pages) == f"Head 0 {'text 0 ' * 9}".strip()
    assert "Tell your friends." in text_of(*pages[:-1])


def test_names_with_other_meanings_do_no_harm():
    page = "<article><p>a</p><div class='related-work'>b</div><div class='ad-hoc'>c</div><div class='post-header'>d</div><div class='related-posts'>e</div><ul class='comment-list'><li>f</ul></article>"
    assert text_of(page) == "a b c d"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def nameless(rng, pages):
    """Pages of one host in markup that names nothing, and what each says."""
    menu = "".join(f"<li><a href=/{k}>{words(rng, 1)}</a>" for k in range(rng.randint(3, 6)))
    notice, foot = words(rng, 40), words(rng, 5)
    made = []
    for _ in range(pages):
        text = [words(rng, 6)]
        body = f"<h1>{text[0]}</h1>"
        for _ in range(rng.randint(2, 9)):
            text.append(words(rng, rng.randint(20, 80)))
            tag = rng.choice(["p", "p", "p", "h2", "blockquote", "pre"])
            body += f"<{tag}>{text[-1]}</{tag}>"
        advert = f"<div>{words(rng, 5)}</div>" if rng.random() < 0.7 else ""
        late = f"<div><h3>{words(rng, 2)}</h3><span>{words(rng, 3)}</span></div>" if rng.random() < 0.5 else ""
        made.append((f"<body><div><ul>{menu}</ul></div><div>{notice}</div>{advert}<div>{body}</div>{late}<div>{foot} {words(rng, 2)}</div></body>", " ".join(text)))
    return made


def test_nameless_hosts_against_what_their_pages_say():
    for seed in range(20):
        made = nameless(random.Random(seed), 10)
        for k, (page, says) in enumerate(made):
            others = [p for p, _ in made[:k] + made[k + 1 :]]
            assert text_of(page, *others) == says, (seed, k)


def test_a_lone_nameless_page_keeps_its_article():
    page, says = nameless(random.Random(3), 1)[0]
    assert says in text_of(page)


def test_pages_without_names_read_like_those_with_names():
    """The test pages with every telling tag and class taken out: positions, slots and weights decide."""
    import pyarrow.parquet as pq

    hosts = {}
    for row in pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist():
        hosts.setdefault(re.sub(r"^\w+://([^/]*).*", r"\1", row["url"] or ""), []).append(row["html"])
    several = [pages for pages in hosts.values() if len(set(pages)) > 1][:12]
    assert several
    for pages in several:
        bare = [re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", p).replace(' class="ad"', "") for p in pages]
        judged = H.judge(wrapper_of(*bare), len(bare))
        for page, plain in zip(pages, bare):
            article = re.search(r"(?s)<article>(.*)</article>", page)[1]
            assert H.read(H.parse(plain), judged) == text_of(f"<article>{article}</article>")


def regex_of(item):
    """A wrapper as a regular expression over tokens, without alternatives."""
    inner = "".join(regex_of(i) for i in item[5])
    if item[0] == "~":
        return f"(?:{''.join(f'(?:{regex_of(i)})?' for i in item[5])})*"
    one = "#" if item[0] == "#" else f"<{re.escape(item[0])}>{inner}</>"
    return f"(?:{one}){'+' if '+' in item[1] else ''}" if "?" not in item[1] else f"(?:{one}){'*' if '+' in item[1] else '?'}"


def tokens_of(node):
    return f"<{node[0]}>{''.join('#' if isinstance(c, int) else tokens_of(c) for c in node[1])}</>"


def some_html(rng, depth=3):
    out = ""
    for _ in range(rng.randint(0, 4)):
        tag = rng.choice(["div", "section", "p", "ul", "h2", "#"])
        out += words(rng, 2) if tag == "#" else f"<{tag}>{some_html(rng, depth - 1) if depth and tag != 'p' else 'x'}</{tag}>"
    return out


def test_wrappers_cover_all_their_pages():
    for seed in range(60):
        rng = random.Random(seed)
        pages = [some_html(rng) for _ in range(rng.randint(1, 5))]
        wrapper = re.compile(regex_of(wrapper_of(*pages)))
        for page in pages:
            assert wrapper.fullmatch(tokens_of(H.parse(page)[0])), (seed, page)


def test_alignment_against_all_common_subsequences():
    def item(tag, *inner):
        return [tag, "", 1, 0, {}, [["~", "+", 0, 0, {}, [[i, "", 1, 0, {}, [], []] for i in inner], []]] if inner else [], []]

    def weight(i, j):
        return 1 + 2 * H._alike(i, j)

    for seed in range(150):
        rng = random.Random(seed)
        x, y = ([item(rng.choice("ab"), *rng.sample(["p", "h1", "ul"], rng.randint(0, 3))) for _ in range(rng.randint(0, 5))] for _ in range(2))
        best = 0.0
        for n in range(min(len(x), len(y)) + 1):
            for i in itertools.combinations(x, n):
                for j in itertools.combinations(y, n):
                    if all(a[0] == b[0] for a, b in zip(i, j)):
                        best = max(best, sum(weight(a, b) for a, b in zip(i, j)))
        pairs = H.aligned(x, y)
        assert [i for i, _ in pairs if i] == x and [j for _, j in pairs if j] == y
        fast = len(x) == len(y) and all(a[0] == b[0] and H._alike(a, b) > 0 for a, b in zip(x, y))
        got = sum(weight(i, j) for i, j in pairs if i and j)
        assert fast or abs(got - best) < 1e-9


def test_mismatches_become_optional_and_repeated():
    wrapper = wrapper_of("<div><section>x</section></div>", "<div><section>y</section><section>z</section><form>t</form></div>")
    div = wrapper[5][0]
    assert [(i[0], i[1]) for i in div[5]] == [("section", "+"), ("form", "?")]
    assert div[5][0][5][0][5][0][4] == {}  # a slot: no constant is left


def test_wrapper_does_not_grow_with_pages():
    wrapper, sizes = None, []
    for n in range(1, 60):
        own = H._bare(H.pattern(H.parse("<article>" + "<p>x</p>" * n + f"<h2>{n}</h2>" * (n % 2) + f"<div class=c{n}>y</div>" * n + "</article>")))
        wrapper = own if wrapper is None else H.align(wrapper, own)
        sizes.append(len(json.dumps(wrapper)))
    assert max(sizes[6:]) <= sizes[5] + 12  # counters gain digits


def test_deep_wide_and_long_pages():
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after</p>"
    assert text_of(deep) == text_of(deep, "<p>x</p>") == "deep after"
    wide = "".join(f"<{t}>{t}{k}</{t}>" for k in range(5000) for t in ("div", "section", "p")[: 1 + k % 3])
    assert len(text_of(f"<article>{wide}</article>", "<article><p>x</p></article>").split()) == sum(1 + k % 3 for k in range(5000))
    long = "".join(f"<p>w{k}</p>" for k in range(60_000))
    assert len(text_of(f"<article>{long}</article>").split()) == 60_000
    assert text_of("<b>" * 20_000 + "x" + "<div></div>" * 20_000) == "x"


def test_data_frames(spark):
    rows = [(i, f"https://Host{i % 2}.org/x{i}", PAGE.format(title=f"t{i}", first="f", second="s" * i)) for i in range(12)]
    rows += [(50, None, "<p>alone</p>"), (51, "no url", None), (52, "https://host0.org", ""), (0, rows[0][1], rows[0][2]), (None, None, "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("c") for c in ("host", "wrapper", "text", "salt", "n", "alone")})
    got = H.extract(df).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[3] == "t3 f sss one two" and by_id[51] == by_id[52] == ""
    assert H.extract(df.limit(0)).count() == 0


def test_partial_wrappers_meet(spark, monkeypatch):
    monkeypatch.setattr(H, "HOSTS_HELD", 0)
    rows = [(i, "http://a.b/c", f"<div class='top'><p>same</p></div><div><p>text {i}</p></div>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    assert [r["n"] for r in H.wrappers(df).collect()] == [40]
    assert {r["text"] for r in H.extract(df).collect()} == {f"text {i}" for i in range(40)}


def test_long_constant_text_goes_and_a_lone_page_keeps_its_text(spark):
    notice, short = "A notice that every page has. " * 10, "a few words"
    make = "<nav><p>Menu</p></nav><div class=x><p>{}</p></div><div><p>{}</p></div>"
    rows = [(k, "http://a.b/c", make.format(notice, f"text {k}")) for k in range(3)]
    rows += [(10 + k, "http://c.d/e", make.format(notice, short)) for k in range(3)] + [(20, "http://e.f", make.format(short, notice)), (21, "http://e.f", None)]
    # an element of one page is not constant, and the empty page makes nothing optional
    rows += [(30, "http://g.h", make.format(notice, "one")), (31, "http://g.h", make.format(notice, "two") + f"<section>{notice}</section>"), (32, "http://g.h", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    both = f"{notice}{short}"
    assert got == {k: f"text {k}" for k in range(3)} | {10 + k: both for k in range(3)} | {20: f"{short} {notice.strip()}", 21: "", 30: "one", 31: f"two {notice.strip()}", 32: ""}
