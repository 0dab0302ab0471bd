"""Line blocks: window sums, marks as weights, pages without an article element."""

import html
import os
import random
import re

import pytest

from catalith.llm.pages import LIGHT, extract, main_text, stretches

FOLDER = "/root/testdata/sf0.01"
TEXT = "A long paragraph of the story that goes on for a while and ends with a full stop."


def kept(weights, window, surge, dive):
    """Lines by definition: in a window of a run of windows that don't dive and of which one surges, without light ends."""
    window = min(window, len(weights))
    alive = [sum(weights[i : i + window]) >= dive for i in range(len(weights) - window + 1)] if weights else []
    out = set()
    for i in range(len(alive)):
        for j in range(i, len(alive)):
            run = all(alive[i : j + 1]) and (i == 0 or not alive[i - 1]) and (j + 1 == len(alive) or not alive[j + 1])
            if run and any(sum(weights[k : k + window]) >= surge for k in range(i, j + 1)):
                heavy = [k for k in range(i, j + window) if weights[k] >= LIGHT]
                out |= set(range(heavy[0], heavy[-1] + 1)) if heavy else set()
    return out


def test_window_sums():
    random.seed(3)
    for _ in range(3000):
        weights = [random.choice([0, 5, 12, 30, 90]) for _ in range(random.randint(0, 14))]
        window = random.randint(1, 4)
        got = {i for a, b in stretches(weights, window, 75, 45) for i in range(a, b)}
        assert got == kept(weights, window, 75, 45), (weights, window)


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div id="page" class="site has-sidebar"><article><p>{TEXT}</p></article></div>', TEXT),
        (f'<div class="widget"><p>{TEXT}</p><p>{TEXT}</p></div>', f"{TEXT} {TEXT}"),
        (f'<div class="comments"><p>{TEXT}</p><p>{TEXT}</p></div><p>Short one.</p>', "Short one."),
        (f"<div>Home</div><div>Products</div><div>Contact us today</div><p>{TEXT}</p><p>{TEXT}</p>", f"{TEXT} {TEXT}"),
        (f"<p>{TEXT}</p><div>Home</div><div>Products</div><div>Contact</div><div>Help</div><p>{TEXT}</p>", f"{TEXT} {TEXT}"),
        (f"<p>{TEXT}</p><p>So it was.</p><p>Yes.</p><p>{TEXT}</p>", f"{TEXT} So it was. Yes. {TEXT}"),
        (f'<article><section class="notice-of-meeting">{TEXT}</section><p>x</p></article>', f"{TEXT} x"),
        (f"<article><h1>Title</h1><p>{TEXT}</p><ul><li>Eggs<li>Milk<li>Flour<li>Salt</ul></article>", f"Title {TEXT} Eggs Milk Flour Salt"),
        (f"<article><p>{TEXT}</p>" + "<p><a href=/x>More</a></p>" * 5 + f"<p>{TEXT}</p></article>", f"{TEXT} {TEXT}"),
    ],
)
def test_windows_decide(page, want):
    assert main_text(f"<html><body>{page}</body></html>") == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the synthetic tables")
def test_without_article_elements(spark):
    pages = [r[0] or "" for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("html").collect()]
    same = 0
    for page in pages:
        article = re.search(r"(?s)<article>(.*?)(</article>|$)", page)[1]
        blocks = re.split(r"</?(?:p|h1|br)[^>]*>", re.sub("</?b>", "", article))
        want = " ".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)
        assert main_text(page) == want
        same += main_text(re.sub("<(/?)article>", r"<\1div>", page)) == want
    assert same / len(pages) > 0.95


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "t", 2, 3, "l")], "page_id int, url string, html string, text string, n_chars int, plain int, `Line` string")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text"] and got.collect()[0]["text"] == "x"
