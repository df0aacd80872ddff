"""The conversation trie against a plain one in memory."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from cohortloom.llm import catalog, trie

from .conftest import words

SCHEMA = "conv_id long, turn long, role string, text string, key string, keys string, own boolean, depth int, n_convs string, skip int"
MORE = ("k", "ks", False, 3, "n", 9)


def rebuilt(rows, family=20):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv in own:
        own[conv].sort(key=lambda t: t[:2])
    out = {}
    for conv, mine in own.items():
        h = zlib.crc32(str(conv).encode()) % 4 if family else 0
        base = conv - (abs(conv) % family) * (1 if conv >= 0 else -1) if family else conv
        out[conv] = tuple((r, t) for _, _, r, t in own.get(base, [])[:h] + mine[h:])
    return out


def plain_nodes(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for conv, path in convs.items():
        ends[path].append(conv)
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    children, leaves, saved = Counter(), Counter(), Counter()
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, who in members.items():
        own = (len(who) - 1) * len(words(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += not children[path]
    return Counter(
        (min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children[path], leaves[path], saved[path],
         hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest())
        for path, who in members.items()
    )


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def awkward_rows():
    rows = [(None, 0, "user", "nobody"), (None, None, None, None)]
    for conv in [*range(0, 45), 60, 61, 62, 63, 101, 105, 119, -5, -20, -21, -39, 2**63 - 1, -(2**63)]:
        for turn in range(conv % 7 + 1):
            rows.append((conv, turn, ("user", "assistant")[turn % 2], f"turn {turn} of kind {conv % 3 if turn < 2 else conv % 5} {'w ' * turn}"))
    rows += [(200, None, None, None), (200, 1, "user", None), (200, 2, None, "x"), (201, None, "", ""), (201, 1, "user", ""), (201, 2, "", "x")]
    rows += [(conv, t, "user", f"same {t}") for conv in range(300, 380) for t in range(4)]
    rows += [(conv, t, "user", f"long {t if t != 12 else conv}") for conv in (401, 402, 403) for t in range(conv - 388)]
    rows += [(conv, t, "user", f"alone {'w ' * (t % 3)}{t if t < 6 else t + conv // 10}") for conv in (600, 601, 602, 610, 640) for t in range(conv % 3 + 18)]
    rows += [(500, 3, "user", "twice"), (500, 3, "user", "twice"), (501, 0, "a", "b:c"), (502, 0, "a:b", "c"), (503, 0, "", " " * 3), (504, 0, "user", "y " * 30_000)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("segment,list_ids", [(4, 3), (16, 20_000)])
def test_families(spark, segment, list_ids):
    got = trie.trie(trie.with_family_starts(trie.turns(table(spark, awkward_rows()))), segment, list_ids)
    assert found(got) == plain_nodes(rebuilt(awkward_rows()))


def test_plain_conversations(spark):
    rows = [r for r in awkward_rows() if r[0] is not None and r[0] > 30]
    got = trie.trie(trie.plain(trie.turns(table(spark, rows))), 5)
    assert found(got) == plain_nodes(rebuilt(rows, None))


def test_no_conversations(spark):
    assert trie.trie(trie.with_family_starts(trie.turns(table(spark, [])))).collect() == []
    assert trie.trie(trie.plain(trie.turns(table(spark, awkward_rows()[:2])))).count() == 0


def test_only_a_turnless_conversation(spark):
    conv = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(conv, 0, "user", "gone")]
    got = found(trie.trie(trie.with_family_starts(trie.turns(table(spark, rows)))))
    assert got == Counter([(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())])


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(catalog.QUERIES["op12_conversation_trie"](spark, small)) == plain_nodes(rebuilt(rows))
