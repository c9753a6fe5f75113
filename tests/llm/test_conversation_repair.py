import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from lumenframe.llm import conversation_repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        held = out[conv]
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        order = (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest())
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        held += [(order, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in out.items()}


def plain_repair(rows):
    """Every cheapest sequence of edits by recursion over (row, last role), the least audit by comparing texts."""
    seen, faults = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0d]", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)

    @lru_cache(None)
    def best(i, last, inserted):
        options = []
        wanted = "a" if last == "u" else "u"
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 2:
            cost, audit, out = best(i, wanted, inserted + 1)
            options.append((cost + 2, "I" + audit, ({"u": "user", "a": "assistant"}[wanted] + ":",) + out))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, last, 0)
            options.append((cost + 3, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if role[:1] == wanted or (role[:1] == "s" and last == ""):
                    cost, audit, out = best(i + 1, role[:1], 0)
                    options.append((cost + extra, "K" + audit, (f"{role}:{text}",) + out))
                cost, audit, out = best(i + 1, wanted, 0)
                options.append((cost + 2 + extra, "R" + audit, ({"u": "user", "a": "assistant"}[wanted] + ":" + text,) + out))
        return min(options) if options else (1 << 30, "", ())

    cost, audit, out = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def fixture():
    rng = np.random.default_rng(6)
    texts = [None, "", " \n", "Yes.", "No!", "cut off", "ends here.  ", "é?", " ", "a.b", "long " * 50 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "useless", "User"]
    rows = []
    for conv in [*range(120), -3, None, 10 ** 12]:
        for t in range(int(rng.integers(1, 9)) if conv else 40):
            turn = int(t + (t > 4) * 3) if rng.random() > 0.1 else None
            role = roles[t % 2] if rng.random() > 0.4 else roles[rng.integers(len(roles))]
            rows.append((conv, turn, role, texts[rng.integers(len(texts))] if rng.random() > 0.5 else f"answer {t}."))
    rows += [(3, 90, "assistant", "very long " * 300_000 + "."), (3, 91, "assistant", "very long " * 300_000 + ".")]
    return rows + [(1, 2, "user", "twice."), (1, 2, "user", "twice."), (1, 2, "assistant", "twice.")]


@pytest.mark.parametrize("block", [3, 4096])
def test_matches_brute_force(spark, block):
    rows = fixture()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, key int, audit string")
    got = conversation_repair.repair_damaged(frame, block)
    assert got.columns == COLUMNS
    want = sorted(((c, *plain_repair(v)) for c, v in plain_damage(rows).items()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = conversation_repair.repair_damaged(frame)
    assert got.columns == COLUMNS and got.collect() == []


def test_ranks_order_nodes_by_their_audits():
    rng = np.random.default_rng(7)
    codes = [rng.integers(0, 12, 9).astype(np.uint8)]
    _, _, label, after = conversation_repair._layers(codes, conversation_repair._END[None, :, None], True)
    rank, _ = conversation_repair._ranked(label, after, 32)
    audits = []
    for node in range(len(label)):
        text = ""
        while label[node]:
            text, node = text + chr(label[node]), after[node]
        audits.append(text)
    assert np.array_equal(np.unique(audits, return_inverse=True)[1], rank)


def test_blocks_agree_with_one_block():
    rng = np.random.default_rng(8)
    for _ in range(40):
        code = rng.integers(0, 12, 30).astype(np.uint8)
        end = conversation_repair._END
        whole, audit = conversation_repair.paths([code], end[None])
        left, right = code[:11], code[11:]
        behind = (conversation_repair.matrices([right])[0] + end).min(1)
        first, a = conversation_repair.paths([left], behind[None])
        last, b = conversation_repair.paths([right], end[None])
        state = first[0, 0]
        assert (last[0, state], a[0][0] + b[0][state]) == (whole[0, 0], audit[0][0])
