import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from kgloom.llm import html_text, warc


def text_of(html):
    return html_text.kept_blocks(html, None)[0]


def test_blocks_of_broken_markup():
    page = "<html><head><title>no</title></head><body><nav><ul><li>menu</ul></nav><article><h1>T &amp;&nbsp;U</h1><p>a <b>b<br>c<p>d<i>e</i>f<div class=comments><p>no</div><ul><li>1<li>2</ul></article><footer>no"
    assert text_of(page) == ["T & U", "a b c", "def", "1", "2"]
    assert text_of(None) == text_of("") == []
    assert text_of("<div class='sidebar'>x</div><p>only") == ["only"]
    assert text_of("<form>f</form><div hidden>h</div><header>h</header><div role=main><header><h1>ok</h1></header></div><script>var a = '<p>';</script>") == ["ok"]
    assert text_of("<html><title>Site name</title><p>x") == ["x"]
    assert text_of("<![if IE]><![weird[<p>x<![") == ["x"] and text_of("<p>x<!-- y <p>z") == ["x"] and text_of("<p>x<a href='y") == ["x"]


def test_names_are_a_prior():
    assert text_of("<article class=related-work><p>a<div class=post-footer-note>b</div><p>c</article>") == ["a", "b", "c"]
    assert text_of("<div class='box ad'>no</div><div id=comments>no</div><div class=adhoc>yes, more than that</div>") == ["yes, more than that"]
    assert text_of("<div class=menu-layout><article>a long one<article class=comment>no</article></article></div><p>outside") == ["a long one"]


def test_what_was_lost_by_names_forms_and_teasers(spark):
    """On a host with a tree and without one: a form around the page, a teaser article beside the text, suspicious names within an article; readers' comments go."""
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))

    def cases(i):
        text, tail = words(i, 9 + i % 5), words(i + 500, 4)
        more = f"<p>{words(i + 900, 3)}" * (1 + i % 4)
        own = "\n".join([words(i + 900, 3)] * (1 + i % 4))
        return {
            "form": (f"<body><nav>Home</nav><form id=aspnetForm><div class=top>All of it</div><article><p>{text}{more}</article></form>", f"{text}\n{own}"),
            "plainform": (f"<body><nav>Home</nav><form id=aspnetForm><div class=c><p>{text}{more}</div></form>", f"{text}\n{own}"),
            "teaser": (f"<body><div id=content><p>{text}{more}<p>{tail}</div><article>Teaser {i}</article>", f"{text}\n{own}\n{tail}\nTeaser {i}"),
            "names": (f"<body><article><p>{text}<section class=social>{more}</section><div class='search results'><p>{tail}{more}</div></article>", f"{text}\n{own}\n{tail}\n{own}"),
            "readers": (f"<body><article><p>{text}{more}</article><section class=user-feedback><p>{tail}</section>", f"{text}\n{own}"),
        }

    rows = [(f"http://{kind}{size}/{i}", *case) for size in (40, 1) for i in range(size) for kind, case in cases(i).items()]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string, want string")
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    wrong = [(u, got[i], want) for i, (u, _, want) in enumerate(rows) if got[i] != want and not (u.startswith("http://form1/") and got[i].endswith(want)) and not (u.startswith("http://teaser1/") and want.startswith(got[i]))]
    assert not wrong, wrong[:3]


def test_deep_pages_cost_no_more_than_their_length():
    blocks = html_text.blocks_of("<div>" * 50_000 + "x" + "</b></q></p></div>" * 50_000 + "<p>y")
    assert [b[3] for b in blocks] == ["x", "y"]


def brute_tree(pages, hints):
    """Importance of each (host, branch), the number of its pages and what is said of it, and the low nodes of each host."""
    hosts = defaultdict(dict)
    for url, html in pages:
        blocks = html_text.blocks_of(html, hints)
        host = re.sub(r"^\s*[a-z]*:?//([^/?#]*).*$", r"\1", url or "//").lower()
        if blocks:
            hosts[host].setdefault(tuple(dict.fromkeys((b, leaf, t) for b, leaf, said, t in blocks if said > html_text.NOISE)), blocks)
    tree, low = {}, defaultdict(set)
    log = lambda n, m: math.log(n) / math.log(m)
    shapes = lambda c, m: -sum(n / m * log(n / m, m) for n in c.values()) if m > 1 else 1.0
    worth = lambda c, m: 1 - sum(n * log(n, m) for n in c.values()) / sum(c.values()) if m > 1 else 1.0
    for host, distinct in hosts.items():
        texts, layouts, said, one = defaultdict(Counter), defaultdict(Counter), {}, {}
        for blocks in distinct.values():
            for b, leaf, s, t in set(blocks):
                texts[b][leaf, t] += 1
                said[b] = s
            for b in {x[0] for x in blocks}:
                layouts[b][tuple(x[1] for x in blocks if x[0] == b)] += 1
        for b in texts:
            n = sum(layouts[b].values())
            one[b] = (0.5 * shapes(layouts[b], n) + 0.5 * worth(texts[b], n), n, said[b])
            tree[host, b] = one[b]
        best = max((i for i, n, s in one.values() if n >= 3 and s > html_text.NOISE), default=None)
        if len(distinct) >= 3 and best is not None:
            low[host] = {("branch", b) for b, (i, n, s) in one.items() if n >= 3 and i < html_text.LIMITS[s] * best and n >= 0.05 * len(distinct)}
            low[host] |= {("text", *k) for b, c in texts.items() if said[b] < html_text.ARTICLE for k, n in c.items() if n >= 3 and -math.log2(n / len(distinct)) < 0.2}
    return tree, low


def brute_text(host, html, low, hints):
    blocks = [b for b in html_text.blocks_of(html, hints) if b[2] > html_text.NOISE]
    if host in low:
        return "\n".join(t for b, leaf, s, t in blocks if ("branch", b) not in low[host] and not (s < html_text.ARTICLE and ("text", leaf, t) in low[host]))
    kinds = [[t for *_, s, t in blocks if s >= k] for k in ((html_text.DOUBTED, html_text.PLAIN) if hints else ())]
    most = next((k for k in kinds if k and 2 * len("".join(k)) >= len("".join(t for *_, t in blocks))), [t for *_, t in blocks])
    return "\n".join(most)


def made_pages(rng):
    """Hosts of many, few and one page, with template text that names itself and that doesn't, copies, and pages without articles."""
    say = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(n))
    pool = [say(3) for _ in range(6)]
    out = []
    for host, n in (("big.example", 60), ("small.example", 5), ("one.example", 1)):
        for i in range(n):
            body = f"<article><h1>{say(4)}</h1><h3>{('Methods', 'Summary')[i % 2]}</h3><p>{say(12)}<p>{say(9)}</article>" if i % 3 else f"<div class=text><h2>{say(4)}</h2><p>{say(12)}</div>"
            out.append((f"http://{host}/{i}", f"<body><div class=top>Welcome</div><div class=box{i}><a href=x>{rng.choice(pool)}</a> <i>{rng.choice(pool)}</i></div><div class=site-menu><ul><li>{rng.choice(pool)}<li>{rng.choice(pool)}</ul></div>{body}<div class=comments><p>{say(7)}</div><footer>{rng.choice(pool)}</footer>"))
    return out + out[:9] + [(None, "<p>lost"), ("http://big.example/x", None), ("http://big.example/x", "")]


def test_style_tree_equals_brute_force(spark):
    pages = made_pages(random.Random(1))
    frame = spark.createDataFrame([(i, u, h, "clash", 1) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string, low int").repartition(3)
    removed = {}
    for hints in (True, False):
        tree, low = brute_tree(pages, hints)
        rows = html_text.with_site(frame, "page_id", "url", "html")
        got = {(r.host, r.branch % 2**64): (r.importance, r.pages, r.said) for r in html_text.style_tree(html_text.nodes(rows, hints))[0].collect()}
        assert got.keys() == tree.keys() and all(got[k][1:] == tree[k][1:] and abs(got[k][0] - tree[k][0]) < 1e-9 for k in tree)
        out = {r.page_id: r for r in html_text.main_text(frame, hints=hints).collect()}
        assert len(out) == len(pages)
        for i, (u, h) in enumerate(pages):
            host = re.sub(r"^http://([^/]*).*$", r"\1", u or "")
            assert out[i].text == brute_text(host, h, low, hints) and out[i].n_chars == len(out[i].text)
        removed[hints] = sum(r.n_low > 0 for r in out.values())
        if not hints:
            continue
        big = [out[i].text for i, (u, h) in enumerate(pages) if h and "big" in (u or "")]
        assert not any("Welcome" in t for t in big) and all(re.search(r"<h[12]>(.*?)<", h)[1] in out[i].text for i, (u, h) in enumerate(pages) if h and "big" in (u or ""))
    assert removed[True] > 60 and removed[False] > 60
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_tree_alone_finds_the_articles(spark):
    """Without what elements say: of the given pages, templates go from most, and no article loses text."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url LIKE '%tionsh%' OR url LIKE '%tionble%'")
    want = {r.page_id: r for r in html_text.main_text(pages).collect()}
    got = html_text.main_text(pages, hints=False).collect()
    assert all(set(want[r.page_id].text.split("\n")) <= set(r.text.split("\n")) for r in got)
    assert sum(r.text == want[r.page_id].text for r in got) > 0.9 * len(got) and sum(r.n_low > 0 for r in want.values()) > 0.9 * len(got)


def test_low_nodes_of_many_hosts_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(i, *p) for i, p in enumerate(made_pages(random.Random(2)))], "page_id long, url string, html string")
    sent = sorted(map(str, html_text.main_text(pages).collect()))
    monkeypatch.setattr(html_text, "SEND_ROWS", 0)
    assert sorted(map(str, html_text.main_text(pages).collect())) == sent


def test_large_and_small_hosts_are_judged_alike(spark):
    """Few headings on many pages stay, one text of all pages goes, copies of a page don't count, and three pages are enough."""
    def page(h, i):
        head = ("Introduction", "Methods", "Summary")[i % 3]
        return f"<body><div class=top>Welcome to {h}</div><article><h3>{head}</h3><p>text {i} of its own</article>", f"{head}\ntext {i} of its own"

    def plain(h, i):
        return f"<body><div class=top>Welcome to {h}</div><div class=text><h1>Title {i}</h1><h3>{('Yes', 'No')[i % 2]}</h3><p>text {i}</div>", f"Title {i}\n{('Yes', 'No')[i % 2]}\ntext {i}"

    rows = [(i, "http://large/x", *page("large", i)) for i in range(300)] + [(1000 + i, "http://small/x", *plain("small", i)) for i in range(4)]
    rows += [(2000 + i, "http://copies/x", *plain("copies", max(0, i - 100))) for i in range(130)] + [(3000 + i, "http://plain/x", *plain("plain", i)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got == {r[0]: r[3] for r in rows}


def files_of(path):
    return {int(f.parent.name.split("=")[1]): f.read_bytes() for f in path.rglob("part-*")}


def test_warc_round_trip_and_audit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    rows = [(i, f"http://h/{i}\r\n", f"<p>{'é' * (i % 50)}\r\n\r\nWARC/1.0 {i}") for i in range(150)] + [(None, None, None), (3, "http://h/3", "<p>again")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, value string").repartition(2)
    path, other = tmp_path / "w", tmp_path / "v"
    warc.write(pages, str(path))
    back = sorted((r.record_id, r.html) for r in warc.read(spark, str(path)).collect())
    assert back == sorted((f"<urn:page:{'' if i is None else i}>", h or "") for i, _, h in rows)
    files = files_of(path)
    assert len(files) > 2
    for data in files.values():  # a whole file is a gzip file of WARC records
        assert gzip.decompress(data).startswith(b"WARC/1.0\r\n")

    def stored(record, data):
        if record == "<urn:page:17>":
            return data[:-9] + b"?" + data[-8:]
        return b"\0" + data[1:] if record == "<urn:page:80>" else None if record in ("<urn:page:60>", "<urn:page:>") else data

    warc.write(pages, str(other), stored=stored)
    got = warc.fixity(spark, str(path), str(other)).collect()
    assert len(got) == len(rows)
    status = defaultdict(set)
    for r in got:
        status[r.status].add(r.record_id)
        assert hashlib.sha256(files[r.shard][r.offset : r.offset + r.length]).digest() == r.hash
    assert status["corrupt"] == {"<urn:page:17>", "<urn:page:80>"} and status["missing"] == {"<urn:page:60>", "<urn:page:>"}
    assert set(status) <= {"corrupt", "missing", "moved", "intact"} and len(status["intact"]) > 60
    back = warc.fixity(spark, str(other), str(path)).collect()
    assert sorted(r.record_id for r in back if r.status == "extra") == ["<urn:page:60>", "<urn:page:>"] and len(back) == len(rows)
    assert {r.status for r in warc.fixity(spark, str(path), str(path)).collect()} == {"intact"}
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.fixity(spark, str(tmp_path / "e"), str(tmp_path / "e")).count() == 0


def test_audit_of_one_missing_record_among_many(spark):
    """What follows a missing record has moved, and isn't corrupt; nothing is said of what comes before it."""
    record = lambda i: gzip.compress(b"WARC/1.0\r\nWARC-Record-ID: <r%d>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" % i, mtime=0)
    whole = [record(i) for i in range(600)]

    def table(parts):
        return spark.createDataFrame([(0, *x) for x in warc.file_nodes(b"".join(parts))], warc.NODES)

    cut = table(whole[:300] + whole[301:])
    got = {r.record_id: r.status for r in warc.audit(table(whole), cut).collect()}
    assert {i for i, s in got.items() if s != "moved"} == {"<r300>"} and got["<r300>"] == "missing"
    assert set(got) == {f"<r{i}>" for i in range(300, 600)}
    assert {r.record_id: r.status for r in warc.audit(cut, table(whole)).collect() if r.status != "moved"} == {"<r300>": "extra"}
    few = table(whole[:2])
    assert sorted(r.status for r in warc.audit(table(whole[:20]), few).collect()) == ["missing"] * 18


def test_damaged_files_are_read_on():
    """Any flipped byte harms one record, or two where it joins them, and the rest are found."""
    parts = [gzip.compress(b"WARC/1.0\r\nWARC-Record-ID: <r%d>\r\nContent-Length: 9\r\n\r\nsome text\r\n\r\n" % i, mtime=0) + warc.EMPTY_MEMBER for i in range(6)]
    data = b"".join(parts)
    sound = {warc.record_id(c) for _, _, c, ok in warc.members(data) if ok}
    assert len(sound) == 6
    for at in range(len(data)):
        harmed = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
        found = list(warc.members(harmed))
        assert len(sound & {warc.record_id(c) for _, _, c, ok in found if ok}) >= 4
        assert all(a[0] + a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert warc.fields(b"WARC/1.0\r\nContent-Length: x\r\n\r\nbody\r\n\r\n")[1] == b"body" and warc.record_id(b"WARC/1.0\r\nWARC-Record-ID: <cu") is None
    assert list(warc.members(b"no records at all"))[0][3] is False and list(warc.members(b"")) == []
