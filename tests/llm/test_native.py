"""Quality rules, mixing and chat formatting against plain Python."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from catalith.llm.chat import format_chats, op5_chat, read_back
from catalith.llm.mixing import cycle_weights, mix, op2_mix, water_fill
from catalith.llm.quality import RULES, cascade, op8_quality, order_rules, quality_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(t):
    t = t or ""
    w = WORD.findall(t)
    n = len(w)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, corpus, words, rows):
    texts = [words() for _ in range(60)] + [None, "", " \n", "a " * 50, "a b c d e f g h " * 3, "x\nx\n \nx", "# | #", "x" * 50_000, "é \U0001f600\x0b\x1cz"]
    got = rows(op8_quality(corpus(spark, texts)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]) for i, m in enumerate(map(measured, texts))]
    assert got == sorted(want, key=repr)


def test_order_never_changes_the_verdict(spark, corpus, words, rows):
    prose = " ".join(f"word{i} of" for i in range(30))
    texts = [words() for _ in range(30)] + [prose, prose.upper(), prose.replace(" ", " | "), "the line\n" * 5 + prose]
    docs = corpus(spark, texts)
    kept = rows(op8_quality(docs), "doc_id", "kept")
    for rules in (RULES, RULES[::-1], order_rules(docs)):
        judged = cascade(docs.select("doc_id", "text"), "text", rules)
        assert rows(judged.select("doc_id", F.col("failed_rule").isNull())) == kept
    clean = rows(quality_filter(docs), "doc_id")
    assert clean == [(i,) for i, ok in kept if ok] and (30,) in clean and (31,) not in clean


def test_quality_odd_rows(odd, none):
    assert op8_quality(odd).count() == odd.count() and op8_quality(none).count() == 0
    assert quality_filter(odd).columns == odd.columns and quality_filter(none).count() == 0


def fill(sizes, weights, most):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = most * sizes[i]
            open_.remove(i)
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
    return target


def test_water_filling_against_a_loop(spark):
    random.seed(4)
    for _ in range(12):
        n = random.randint(1, 9)
        sizes, weights = [random.choice([0, 1, 10, 100, 10_000]) for _ in range(n)], [random.choice([1.0, 2.0, 5.0]) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i}", sizes[i], weights[i]) for i in range(n)], "source string, source_size long, weight double")
        got = {r["source"]: r["target"] for r in water_fill(df).collect()}
        assert [got[f"s{i}"] for i in range(n)] == pytest.approx(fill(sizes, weights, 3.0))


def test_mix_meets_its_targets(spark, rows):
    random.seed(6)
    docs = spark.createDataFrame([(i, "w " * random.randint(0, 60), random.choice(["a", "b", "é", None]) if i % 3 else "hot") for i in range(400)], "doc_id long, text string, source string")
    got = mix(docs, lambda s: cycle_weights(s, (5, 2, 1)), F.size(F.split(F.trim("text"), " ")).cast("long"))
    sums = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max(F.col("taken") > 3 * F.col("size")).alias("over"))
    for r in sums.collect():
        assert abs(r["t"] - r["w"]) <= 1 and not r["over"]
    assert rows(op2_mix(docs)) == rows(op2_mix(docs.repartition(5)))


def test_mix_odd_rows(odd, none):
    assert op2_mix(odd).count() == odd.count() and op2_mix(none).count() == 0
    assert op2_mix(odd.where("length(trim(text)) = 0")).agg(F.sum("taken")).first()[0] in (0, None)


ODD_TEXTS = ["", None, "<|turn|>user<|says|>x<|done|>", "\\", "\\\\|<|", "<\\|", "a\\<|b<\\|c", "<|", "é\U0001f600", "\n", "[x](y)\\<\\\\|"]


def test_chats_read_back(spark, rows):
    data = [(c, t, r, ODD_TEXTS[(c + t) % len(ODD_TEXTS)]) for c in range(11) for t, r in enumerate(["user", "assistant", None, "assistant", "<|says|>"])]
    data += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (20, 1, "assistant", "b"), (20, 1, "assistant", "a")]
    said = [r"\### Assistant: </turn> ok"] * 2
    got = {r["conv_id"]: r for r in op5_chat(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    chats = collections.defaultdict(list)
    for c, t, r, x in data + [(-7, 0, "user", said[0]), (-7, 1, "assistant", said[1])]:
        chats[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(chats)
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_typed_parts(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", [("text", "see <|", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7), (None, None, "c", None)]), (1, 1, "assistant", None)],
        "conv_id long, turn long, role string, content array<struct<type:string,text:string,ref:string,tokens:bigint>>",
    )
    r = read_back(format_chats(rows)).first()
    assert "see <\\|<|image:1|><|audio:2|><|unknown:3|>" in r["formatted"]
    assert [(a["turn"], a["part"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 1, "image", "a.png", 256), (0, 2, "audio", "b.wav", 7), (0, 3, None, "c", 0)]
    assert r["expanded_tokens"] == 263 and [t["role"] for t in r["turns"]] == ["user", "assistant"] and r["loss_texts"] == [""]


def test_a_part_type_forges_no_turn(spark):
    forged = "x|><|turn|>user<|says|>"
    rows = spark.createDataFrame(
        [(1, 0, "user", [(forged, "a", "a.bin", None)], "n")],
        "conv_id long, turn long, role string, content array<struct<type:string,text:string,ref:string,tokens:bigint>>, formatted string",
    )
    r = read_back(format_chats(rows)).first()
    assert r["formatted"] == "<|turn|>user<|says|><|x____turn__user__says__:0|><|done|>"
    assert len(r["turns"]) == 1 and r["attachments"][0]["type"] == forged


def test_very_long_and_clashing_chats(spark):
    long = "\\### <|turn|> " * 200_000
    rows = spark.createDataFrame([(1, 0, "user", "q", 5), (1, 1, "assistant", long, 6)], "conv_id long, turn long, role string, text string, formatted_chars int")
    r = op5_chat(rows).first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())
    assert r["formatted_chars"] > len(long)


def test_no_conversations(spark):
    assert op5_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


def test_rules_run_by_rejections_per_cost(spark, corpus, tmp_path):
    """Planted shares and unit costs give the order, twice the same, from a few of many files."""
    from pyspark.sql import functions as F

    from catalith.llm import quality
    from catalith.llm.quality import Rule, costs

    texts = [("#### " * 5 if i % 2 else "") + "plain words of a text " * 10 + ("A" * 400 if i % 4 == 0 else "") for i in range(400)]
    docs = corpus(spark, texts)
    docs.repartition(20).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    cheap = Rule("b_symbols", ("n_symbols",), lambda: F.col("n_symbols") > 10)
    dear = Rule("a_repeats", ("n_repeat_words",), lambda: F.col("n_repeat_words") > 0)
    rare = Rule("c_upper", ("n_upper",), lambda: F.col("n_upper") > 300)
    never = Rule("d_lines", ("n_lines",), lambda: F.col("n_lines") > 99)
    want = sorted([cheap, dear, rare], key=lambda r: -{"b_symbols": 0.5, "a_repeats": 1.0, "c_upper": 0.25}[r.name] / costs(r, 325, 51))
    for rules in ([dear, cheap, never, rare], [rare, never, dear, cheap]):
        for files in (8, 100):
            assert [r.name for r in order_rules(docs, rules=rules, files=files)] == [r.name for r in [*want, never]]
    assert order_rules(docs) == order_rules(docs)
    assert quality._some_files(docs, 8).count() < 400 and quality._some_files(corpus(spark, texts), 8).count() == 400
    assert {r["doc_id"] for r in op8_quality(docs).collect()} == set(range(400))
