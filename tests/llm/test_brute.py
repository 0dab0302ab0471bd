"""Queries that SQL can't express, and the pipeline, against plain Python on the smallest tables."""

import collections
import hashlib
import html
import math
import os
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from catalith.llm.licences import templates  # noqa: E402
from catalith.llm.pii import find, in_order, mask  # noqa: E402
from catalith.llm.registry import queries  # noqa: E402
from tests.llm.test_native import WORD, fill, measured  # noqa: E402
from tests.llm.test_near_dup import brute as groups  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the synthetic tables")
MASKS = ("11110001101", "10011010111", "11101010011")


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [(r["item_id"], tokens(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower)


def best_overlap(t, o):
    """(start, end, matched) of the best stretch on a diagonal that a mask hits, or None."""
    best = None
    for d in range(len(MASKS[0]) - len(o), len(t) - len(MASKS[0]) + 1):
        a, b = max(0, d), min(len(t), len(o) + d)
        equal = [t[i] == o[i - d] for i in range(a, b)]
        if not any(all(equal[k + j] for j, c in enumerate(m) if c == "1") for m in MASKS for k in range(len(equal) - len(m) + 1)):
            continue
        sums, top = [0], (0, 0, 0)
        for e in equal:
            sums.append(sums[-1] + (1 if e else -3))
        for j in range(len(sums)):
            low = min(sums[: j + 1])
            if sums[j] - low > top[0]:
                top = (sums[j] - low, max(i for i in range(j + 1) if sums[i] == low), j)
        _, i, j = top
        good = sum(equal[i:j])
        if j - i >= min(13, len(o)) and 5 * good >= 4 * (j - i) and (best is None or good > best[2]):
            best = (a + i, a + j, good)
    return best


def leaks(texts, items):
    out = {}
    for key, text in texts:
        t = tokens(text)
        near = set(t)
        for item, o in items:
            if len(near & set(o)) >= 4 and (found := best_overlap(t, o)):
                out[key, item] = found
    return out


def test_overlaps(spark, docs, items):
    from catalith.llm.decontaminate import overlaps

    some = [(d["doc_id"], d["text"]) for d in docs if len(d["text"] or "") < 4000]
    known = {k for k, _ in some}
    want = leaks(some, items)
    least = {}
    for i, o in items:
        least[tuple(o)] = min(i, least.get(tuple(o), i))
    named = {(k, least[tuple(dict(items)[i])]): v for (k, i), v in want.items()}
    tables = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"], r["matched"]) for r in overlaps(*tables).collect()}
    assert {k: v for k, v in got.items() if k[0] in known} == named
    rows = {r["doc_id"]: r for r in queries()["op6_decontaminate"](spark, FOLDER).collect()}
    texts = {k: tokens(t) for k, t in some}
    assert known & rows.keys() == {k for k, _ in want}
    for k in known & rows.keys():
        mine = {i: v for (d, i), v in want.items() if d == k}
        assert rows[k]["n_items"] == len(mine) and rows[k]["matched"] == max(v[2] for v in mine.values())
        assert rows[k]["class_id"] == min(d for d, t in texts.items() if t == texts[k])


def test_personal_data(spark, docs):
    got = {r["doc_id"]: (r["spans"], r["base_sha256"]) for r in queries()["op4_pii"](spark, FOLDER).collect()}

    def join(spans):
        return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)

    for d in docs:
        base, more = find(d["text"])
        assert got[d["doc_id"]] == (join(in_order(base + more)), hashlib.sha256(join(base).encode()).hexdigest())


def test_articles(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in queries()["op7_html"](spark, FOLDER).collect()}
    for p in pages:
        article = re.search(r"(?s)<article>(.*?)(</article>|$)", p["html"])[1]
        blocks = re.split(r"</?(?:p|h1|br)[^>]*>", re.sub("</?b>", "", article))
        assert got[p["page_id"]] == " ".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


CUES = re.compile(
    "licence|license|licens|copyright|rights reserved|spdx|public domain|permission is hereby|permission to use|redistribution and use|creative commons|free software|gplv|-clause|zlib", re.I
)
NAMES = re.compile(r"\b(GPL|LGPL|AGPL|MIT|BSD|ISC|MPL|EPL|EUPL|CDDL|OFL|WTFPL|CC BY|CC-BY|CC0|Apache-|Boost Software)")


def cues(text):
    """Starts of cues from left to right, none inside another."""
    out, end = [], 0
    for start, stop in sorted((m.start(), m.end()) for p in (CUES, NAMES) for m in p.finditer(text)):
        if start >= end:
            out.append(start)
            end = stop
    return out


def bag(text):
    return collections.Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower().replace("licence", "license")))


def licence(text, weighted, idf):
    """The licence of the closest template by the cosine of whole dictionaries, over every passage."""
    text = text or ""
    if not cues(text):
        return None
    blocks, run, pieces = [], [], [(text, 0.55)]
    for line in [*text.split("\n"), ""]:
        if re.search(r"[^\W_]", line):
            run.append(line)
        elif run:
            blocks.append(run)
            run = []
    joined = ["\n".join(b) for b in blocks]
    for i in range(len(blocks)):
        for j in range(i + 1, len(blocks) + 1):
            inner = all(cues(b) for b in joined[i:j])
            ends = (i == 0 or not cues(joined[i - 1])) and (j == len(blocks) or not cues(joined[j]))
            if inner and (j == i + 1 or ends):
                pieces.append(("\n".join(joined[i:j]), 0.55))
    for block, b in zip(joined, blocks, strict=True):
        for line in [*b, *re.split(r"(?<=[.;:!?])\s+(?=[A-Z(])", block)]:
            if cues(line):
                pieces.append((line, 0.55))
                if sum(bag(line).values()) > 30:
                    for k in cues(line):
                        before = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", line[max(0, k - 80) : k].lower().replace("licence", "license"))[-6:]
                        after = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", line[k : k + 360].lower().replace("licence", "license"))[:30]
                        near = before + after
                        pieces += [(" ".join(near[i : i + n]), 0.7) for i in range(len(before) + 1) for n in (5, 8, 12, 20, 30)]
    unknown, best = max(idf.values()), {}
    for piece, least in pieces:
        words = bag(piece)
        if sum(words.values()) < 2 or not words.keys() & idf.keys():
            continue
        v = {t: (1 + math.log(n)) * idf.get(t, unknown) for t, n in words.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        for name, w, norm in weighted:
            c = round(sum(x * w[t] for t, x in v.items() if t in w) / size / norm, 9)
            if c >= least:
                rank = (name == "Proprietary", -c, name)
                best = min(best, rank) if best else rank
    return best[2] if best else None


def test_licences(spark, docs):
    collection = [(name, bag(text)) for name, text in templates()]
    df = collections.Counter(t for _, b in collection for t in b)
    idf = {t: math.log(1 + len(collection) / n) for t, n in df.items()}
    weighted = []
    for name, b in collection:
        w = {t: (1 + math.log(n)) * idf[t] for t, n in b.items()}
        weighted.append((name, w, math.sqrt(sum(x * x for x in w.values()))))
    own = {d["doc_id"]: (licence(d["text"], weighted, idf),) for d in docs}
    head = {}
    for d in docs:
        if own[d["doc_id"]][0]:
            head.setdefault((d["source"], d["lang"]), d["doc_id"])
    got = {r["doc_id"]: (r["license"], r["own_license"]) for r in queries()["op3_licenses"](spark, FOLDER).collect()}
    for d in docs:
        mine, near = own[d["doc_id"]][0], head.get((d["source"], d["lang"]))
        assert got[d["doc_id"]] == (mine or (own[near][0] if near is not None else None), mine)


def keeps(text):
    n, chars, symbols, repeated, covered = measured(text)
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    words = WORD.findall(text or "")
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper, lower = (sum(f(c) for c in text or "") for f in (str.isupper, str.islower))
    return not (
        n < 20 or 100 * covered > 30 * n or 100 * stutter > 30 * n or 10 * symbols > n or 100 * repeated > 40 * lines or chars < 3 * n or chars > 12 * n or 10 * upper > 4 * (upper + lower)
    )


def test_pipeline(spark, docs, items):
    rows = [d for d in docs if keeps(d["text"])]
    kept = {i for i, _, _, first in groups([d["text"] for d in rows], 80) if first}
    rows = [d for i, d in enumerate(rows) if i in kept]
    found = {k for k, _ in leaks([(d["doc_id"], d["text"]) for d in rows], items)}
    rows = [d for d in rows if d["doc_id"] not in found]
    for d in rows:
        d["size"] = len(WORD.findall(mask(d["text"], in_order([s for part in find(d["text"]) for s in part]))))
    sizes = collections.Counter()
    for d in rows:
        sizes[d["source"]] += d["size"]
    sources = sorted(sizes)
    targets = dict(zip(sources, fill([sizes[s] for s in sources], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sources))], 3.0), strict=True))
    want, so_far = {}, collections.Counter()
    for d in sorted(rows, key=lambda d: (hashlib.md5(f"17:{d['doc_id']}".encode()).hexdigest(), d["doc_id"])):
        s = d["source"]
        whole = int(targets[s] / sizes[s] + 1e-12)
        rest = max(0, round(targets[s]) - whole * sizes[s])
        want[d["doc_id"]] = whole * d["size"] + max(0, min(d["size"], rest - so_far[s]))
        so_far[s] += d["size"]
    assert {r["doc_id"]: r["taken"] for r in pipeline.run(spark, FOLDER).collect()} == want
