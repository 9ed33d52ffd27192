import random

import pytest

from lodestone.llm.html_text import COPY, common, extract, lines


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_is_longest():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        got = sorted(common(a, b))
        assert len(got) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)  # a subsequence of b


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>T</h1><p>a &amp; b<br>c<p>d  <b>e</b>f</article>", ["T", "a & b", "c", "d ef"]),
        ("<body><nav><ul><li>x<li>y</ul></nav><header>h</header><div class='ad'>buy</div><article><header><h1>t</h1></header><p>x</p><aside>no</aside><form>q</form></article><footer>&copy; z</footer>", ["t", "x"]),
        ("<article>a<div id=comments><article>they said</article></div></article><p>", ["a"]),
        ("<main>m<script>if (a<b) '</p>'</script><!-- <p>c</p> --> n</main>", ["m n"]),
        ("<article><p>open", ["open"]),
        ('<article><p title="a > b">t &lt;x&gt; &#233;&nbsp;u</article>', ["t <x> é u"]),
    ],
)
def test_markup(page, want):
    assert [t for t, kind in lines(page) if kind == 1] == want


def test_differencing(spark):
    page = lambda n: f"<div>Home</div><div>Site {n % 7}</div><p>Text of {n}.</p><p>More {n}</p><div>Bye</div>"
    rows = [(n, f"http://Host{n % 2}.x/a/{n:03}?q", page(n), n) for n in range(40)]
    rows += [(100, None, page(100), 0), (101, "http://alone.y/", page(101), 0), (102, "::bad url", None, 0), (7, "http://host1.x/a/007?q", page(7), 0), (None, "http://z.z", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(4)
    got = {(r.page_id, r.url): r for r in extract(df).collect()}
    assert len(got) == 45 and extract(df).count() == 45
    for n in range(40):
        if n not in (5, 7, 9):
            assert got[n, f"http://Host{n % 2}.x/a/{n:03}?q"].text.startswith(f"Site {n % 7}\nText of {n}.\nMore {n}"), n
    assert got[101, "http://alone.y/"].text.count("\n") == 4
    assert got[102, "::bad url"].text == "" and got[102, "::bad url"].n_chars == 0
    assert extract(df.limit(0)).count() == 0


def test_copies_do_not_delete_each_other(spark):
    def page(n, more=""):
        return f"<div>Home</div><div>All sections</div><p>{f'Text of {n}. ' * 9}</p><p>{f'Second part of {n}. ' * 9}{more}</p>" + "".join(f"<p>{f'Part {i} of {n}. ' * 9}</p>" for i in range(20)) + "<div>Bye</div>"

    kept = lambda n: page(n).replace("<div>Home</div><div>All sections</div>", "").replace("<div>Bye</div>", "").replace(" </p>", "\n").replace("<p>", "").strip()
    rows = [(n, f"http://h.x/a/{n:03}", page(n)) for n in range(6)]
    rows += [(100 + i, f"http://h.x/a/003?ref={i}", page(3)) for i in range(3)]  # recrawls, page 3 beside them
    rows += [(200, "http://h.x/a/004?page=2", page(4, "Edited.")), (300, "http://h.x/a/0030", page(3))]  # a near copy, and one at another path
    rows += [(400, "http://two.x/a", page(40)), (401, "http://two.x/a?b", page(40))]  # nothing but copies
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r for r in extract(df).collect()}
    assert len(got) == len(rows)
    for i, n in [(n, n) for n in range(6)] + [(100, 3), (101, 3), (102, 3), (300, 3)]:
        assert got[i].text == kept(n) and got[i].n_chars == len(kept(n)) and got[i].n_shared == 3, i
    assert got[200].text == kept(4).replace("Second part of 4.\n", "Second part of 4. Edited.\n")
    assert all(got[i].text == "Home\nAll sections\n" + kept(40) + "\nBye" for i in (400, 401))


def test_planted_copy_keeps_its_text(spark):
    page = lambda n: f"<div>Home</div><div>Site {n % 7}</div><p>Text of {n}.</p><p>More {n}</p><div>Bye</div>"
    rows = [(n, f"http://host1.x/a/{n:03}?q", page(n)) for n in (5, 7, 7, 9)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert sorted(r.text for r in got) == [f"Site {n % 7}\nText of {n}.\nMore {n}" for n in (7, 7, 9, 5)]


def brute(rows):
    """The pages' texts by the rule, pair by pair, in one process; the longest common subsequence by its table."""
    from collections import Counter
    from urllib.parse import urlsplit

    pages = []
    for page_id, url, html in rows:
        at = urlsplit(url or "")
        pages.append(((at.hostname or "").lower(), at.path, page_id, url, lines(html or "")))
    pages.sort(key=lambda p: (p[0], p[1], p[2] is not None, p[2] or 0, p[3] is not None, p[3] or ""))

    def copies(a, b):
        x, y = (Counter(t for t, kind in p[4] if kind != 2) for p in (a, b))
        most = max(sum(len(t) * n for t, n in c.items()) for c in (x, y))
        return most > 0 and sum(len(t) * n for t, n in (x & y).items()) >= COPY * most

    def prefix(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    runs = []
    for p in pages:
        if runs and runs[-1][-1][0] == p[0] and copies(runs[-1][-1], p):
            runs[-1].append(p)
        else:
            runs.append([p])
    out = []
    for i, run in enumerate(runs):
        sides = [x[-1] for x in runs[max(0, i - 1) : i]] + [x[0] for x in runs[i + 1 : i + 2]]
        for p in run:
            near = [q for q in sides if q[0] == p[0] and not copies(p, q)]
            best = max(near, key=lambda q: prefix(p[1], q[1])) if near else None  # of equals the first
            a, b = [t for t, _ in p[4]], [t for t, _ in best[4]] if best else []
            gone = common(a, b)
            assert len(gone) == lcs(a, b)
            gone = {j for j in gone if p[4][j][1] != 1}
            out.append((p[2], p[3], "\n".join(t for j, (t, kind) in enumerate(p[4]) if j not in gone and kind != 2), len(gone), sum(kind == 2 and j not in gone for j, (_, kind) in enumerate(p[4]))))
    return sorted(out, key=str)


def planted(r):
    """Hosts with and without an article element, runs of copies longer than a partition, single pages, nulls."""
    rows = []
    for host, n, own in (("a.x", 60, False), ("b.x", 25, True), ("c.x", 1, False), ("d.x", 30, False)):
        for i in range(n):
            text = "".join(f"<p>{' '.join(r.choice(['mo', 'lo', 'ri', 'tas']) for _ in range(12))} {host} {i if host != 'd.x' else i // 12}</p>" for _ in range(4))
            text = f"<article>{text}</article>" if own else f"<div>{text}</div>"
            if host == "d.x":
                r.seed(i // 12)
                text = f"<p>{' '.join(r.choice(['mo', 'lo', 'ri', 'tas']) for _ in range(60))} {i // 12}</p>"
            menu = "".join(f"<li>{x}</li>" for x in ("Home", "News", f"Section {i % 3}"))
            page = f"<ul>{menu}</ul><div class=ad>Buy {i}</div>{text}<div>Terms of {host}</div>"
            rows.append((len(rows), f"http://{host}/{i % 4}/{i:03}", page))
    return [*rows, (900, None, "<p>x</p>"), (901, None, None), (None, "http://a.x/0/004", "<p>no id</p>"), (5, rows[5][1], rows[5][2])]


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_equals_brute_force_for_any_partitioning(spark, parts):
    rows = planted(random.Random(8))
    want = brute(rows)
    assert sum(n for *_, n, _ in want) > 300 and sum(n for *_, n in want) > 20
    old = [(k, spark.conf.get(k)) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")]
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    finally:
        for k, v in old:
            spark.conf.set(k, v)
    assert sorted([(r.page_id, r.url, r.text, r.n_shared, r.n_marked) for r in got], key=str) == want


def test_neighbours_decide_where_markup_does_not(spark):
    """The same page with and without another of its host."""
    rows = [(i, f"http://a.x/{i}", f"<ul><li>Home</li><li>News</li></ul><p>Only page {i} says so</p><p>All rights</p>") for i in (1, 2)]
    make = lambda some: {r.page_id: r for r in extract(spark.createDataFrame(some, "page_id long, url string, html string")).collect()}
    assert make(rows[:1])[1].text == "Home\nNews\nOnly page 1 says so\nAll rights"
    both = make(rows)
    assert [both[i].text for i in (1, 2)] == ["Only page 1 says so", "Only page 2 says so"] and both[1].n_shared == 3


def test_very_long_page():
    a = [f"<p>{i}</p>" for i in range(20_000)]
    b = a[5000:] + [f"<p>other {i}</p>" for i in range(3000)]
    assert common(a, b) == set(range(5000, 20_000))
    assert len(lines("<div>" * 3000 + "deep" + "<p>x</p>" * 20_000)) == 20_001
