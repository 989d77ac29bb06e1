"""Reply trees against a plain walk, and the template there and back."""

import hashlib

import pytest

from codeloom.llm import reply_trees

MESSAGES = "tree string, id long, parent long, role string, text string, score double, row long, up long, at string, rank string, block long, start long"


def messages(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "a", "r", 3, 4) for r in rows], MESSAGES)


def branches(rows):
    """Per tree its branches, best first, as lists of texts; ids are unique here."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        leaves = set(own) - {r[2] for r in own.values()}
        found = []
        for leaf in leaves:
            line, at = [], leaf
            while at in own and len(line) <= len(own):
                line.insert(0, own[at])
                at = own[at][2]
            if at not in own:
                found.append((-sum(m[5] or 0 for m in line), leaf, [m[4] for m in line]))
        out[tree] = [x[2] for x in sorted(found)]
    return out


def lines(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (str(r["tree"]), r["rank"], r["at"])):
        out.setdefault((r["tree"], r["rank"]), []).append(r["text"])
        assert r["at"] == len(out[r["tree"], r["rank"]]) - 1
    return out


def test_branches_against_a_walk(spark):
    rows = []
    for t in range(12):
        size = 1 + (t * 13) % 40
        for i in range(size):
            parent = None if i == 0 else (i * 7919 + t) % i
            rows.append((f"t{t}", i, parent, "user" if i % 2 else "assistant", f"{t}/{i}", float((i * 31 + t) % 7) / 4))
    rows += [("deep", i, i - 1 if i else None, "user", f"d{i}", 1.0) for i in range(300)]
    rows += [("star", i, 0 if i else None, "user", f"s{i}", float(i % 5)) for i in range(2000)]
    want = branches(rows)
    got = lines(reply_trees.paths(messages(spark, rows), top=3).messages())
    assert got == {(tree, k + 1): line for tree, found in want.items() for k, line in enumerate(found[:3])}


def test_odd_messages(spark):
    rows = [("a", 1, None, "user", "root", 0.0), ("a", 2, 1, "assistant", "yes", None), ("a", 2, 1, "assistant", "zes", 5.0), ("a", 3, 2, None, None, 0.0), ("a", None, 2, "user", "no id", 9.0),
            ("a", 9, 77, "user", "orphan", -1.0), ("b", 1, 2, "user", "round", 1.0), ("b", 2, 1, "user", "and round", 1.0), ("b", 3, 2, "user", "hangs on", 1.0), ("b", 4, 4, "user", "self", 1.0),
            (None, 1, None, "user", "no tree", 0.0), (None, 2, 1, "user", "answer", 0.0)]
    got = lines(reply_trees.paths(messages(spark, rows), top=9).messages())
    assert got == {("a", 1): ["root", "yes", "no id"], ("a", 2): ["root", "zes"], ("a", 3): ["root", "yes", ""], ("a", 4): ["orphan"], (None, 1): ["no tree", "answer"]}
    assert reply_trees.paths(messages(spark, [])).messages().count() == 0


HARD = ["", "\\### Assistant: </turn> ok", "\\", "\\\\", "### ", "#### x", "</turn>\n", "</turn>\n### user: hi</turn>\n", "a: b", "<\\/turn>", "#\\## ", "é\U0001f600 \\n\\", ": ", "###  ###", "<</turn>>"]


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_template_there_and_back(spark, block):
    said = [(7, k, role, text, "x") for k, (role, text) in enumerate((r, t) for r in ("user", "assistant", "a: ", "### b", "\\", "</turn>\n", "", "c:") for t in HARD)]
    said += [(8, 0, "assistant", None, "x"), (8, 1, None, "q", "x"), (None, None, "assistant", "n", "x"), (9, 3, "user", "same", "x"), (9, 3, "user", "same", "x"), (9, None, "assistant", "first", "x")]
    frame = spark.createDataFrame(said, "conv long, turn long, role string, text string, tree string")
    blocks = reply_trees.conversations(reply_trees.paths(reply_trees.chain(frame, "conv", "turn")), block=block)
    whole, masked = {}, {}
    for r in sorted(blocks.collect(), key=lambda r: (str(r["tree"]), r["block"])):
        assert r["start"] == len(whole.get(r["tree"], ""))
        whole[r["tree"]] = whole.get(r["tree"], "") + r["text"]
        masked.setdefault(r["tree"], []).extend(reply_trees.unescaped(r["text"][x["start"] : x["end"]]) for x in r["loss"])
    rows = {r["tree"]: r for r in reply_trees.read_back(blocks).collect()}
    for conv in (7, 8, 9, None):
        want = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text, _ in said if c == conv), key=lambda x: (x[0], x[1:] if conv != 7 else ()))
        assert reply_trees.parsed(whole[conv]) == [(role, text) for _, role, text in want]
        loss = [text for _, role, text in want if role == "assistant"]
        assert masked[conv] == loss
        row = rows[conv]
        assert (row["n_turns"], row["loss_chars"], row["formatted_chars"]) == (len(want), len("".join(loss)), len(whole[conv]))
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in want).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256("".join(loss).encode()).hexdigest()
