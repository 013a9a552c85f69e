"""The content slot by aligned trees alone: no article, no telling tag or class name, everything around it varies."""

import random

import pytest

from provmart.llm import html_wrapper as w


def prose(r, n):
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9))) for _ in range(n))


def page(r, kind):
    """(html, main text) of one of three hosts' layouts."""
    menu = "".join(f'<a href="/{k}">{prose(r, 1)}</a> ' for k in range(r.randrange(4, 9)))
    title, parts = prose(r, 5), [prose(r, r.randrange(30, 120)) for _ in range(r.randrange(1, 4))]
    if r.random() < 0.2:
        parts.append(parts[0])  # a paragraph twice
    body = "".join(f"<p>{p}</p>" for p in parts)
    advert, imprint = prose(r, r.randrange(4, 12)), prose(r, r.randrange(3, 9))
    extra = f"<section class=z>{prose(r, 6)}</section>" if r.random() < 0.3 else ""
    if kind == 0:  # the title beside the text, in a container of its own
        html = f"<body><div class=k1><ul><li>{menu}</ul></div><div class=k2>{advert}</div>{extra}<div class=k3><div class=k4><h1>{title}</h1></div><div class=k5>{body}</div><div class=k6>same on all</div></div><div class=k7>{imprint}</div></body>"
    elif kind == 1:  # title and text in one container, the advert after it
        html = f"<body><div>{menu}</div><section class=q><h2>{title}</h2>{body}</section><div>{advert}</div>{extra}<div class=e>{imprint} <a href=x>{prose(r, 2)}</a></div></body>"
    else:  # the title in the outer container itself
        html = f"<body><div class=a>{imprint}</div><div class=b><h1>{title}</h1><div class=c>{body}</div></div>{extra}<div class=d>{advert}</div></body>"
    return html, "\n\n".join([title, *parts])


@pytest.mark.parametrize("kind", [0, 1, 2])
@pytest.mark.parametrize("lists", [True, False])
def test_the_slot_is_found_without_names(kind, lists, monkeypatch):
    if not lists:
        for name in ("WORDS", "ROLES", "INSIDE"):
            monkeypatch.setattr(w, name, set())
        monkeypatch.setattr(w, "DROPPED", {"script", "style"})
    r = random.Random(kind)
    pages = [page(r, kind) for _ in range(30)]
    wrapper = w.induce([p for p, _ in pages])
    assert [w.main_text(p, wrapper) for p, _ in pages] == [t for _, t in pages]
    assert sum(w.main_text(p) == t for p, t in pages) == 0  # without alignment nothing tells them apart


def test_texts_that_come_again_and_lists_of_links_go():
    r = random.Random(9)
    adverts = [prose(r, 30) for _ in range(3)]
    pages = [f"<body><div class=x>{adverts[i % 3]}</div><div class=y>short {i}</div><div class=y2><a>{prose(r, 30)}</a></div></body>" for i in range(20)]
    wrapper = w.induce(pages)
    assert [w.main_text(p, wrapper) for p in pages] == [f"short {i}" for i in range(20)]


def test_without_a_clear_slot_all_that_varies_stays():
    pages = [f"<body><div class=a>left {i} and more of it</div><div class=b>right {i} and more of it</div></body>" for i in range(9)]
    wrapper = w.induce(pages)
    assert all(key is None for _, key in wrapper.values()) or not wrapper
    assert w.main_text(pages[3], wrapper) == "left 3 and more of it\n\nright 3 and more of it"


def test_extraction_on_a_cluster_equals_that_of_one_host_at_hand(spark, monkeypatch):
    """Hosts of all kinds, a host of one page, repeated and empty pages; wrappers sent and joined."""
    r = random.Random(4)
    rows = [(i, f"https://h{i % 3}.example/{i}", page(r, i % 3)[0]) for i in range(90)]
    rows += [(100, "https://one.example/", page(r, 0)[0]), (101, rows[0][1], rows[0][2]), (102, "https://h1.example/e", ""), (103, None, rows[1][2]), (104, "https://h2.example/n", None)]
    hosts = {}
    for i, url, html in rows:
        hosts.setdefault(url and url.split("/")[2], []).append(html or "")
    known = {h: w.induce(p) if h else {} for h, p in hosts.items()}
    want = {i: w.main_text(html, known[url and url.split("/")[2]]) for i, url, html in rows}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for bound in (32 << 20, -1):
        monkeypatch.setattr(w, "BROADCAST_BYTES", bound)
        assert {x.page_id: x.text for x in w.extract(df).collect()} == want
