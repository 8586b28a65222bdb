"""Merkle manifest, WARC archives and conversation repair against brute force, on small inputs with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from webjourney.llm import merkle, repair, warc

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOCS = "doc_id long, source string, lang string, n_chars long, text string, key string, pos int, n int, leaf string"


def as_text(row):
    return tuple(map(str, row))


# --- Merkle manifest --------------------------------------------------------------------

def leaf_of(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tiers(nodes):
    out = []
    while len(nodes) > 1:
        out.append(nodes)
        nodes = [H("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
    return out, nodes[0]


def folded(levels, i, value, proof):
    for nodes in levels:
        run, slot = nodes[i // 16 * 16:i // 16 * 16 + 16], i % 16
        proof.extend(run[:slot] + run[slot + 1:])
        value, i = H("".join(run[:slot] + [value] + run[slot + 1:])), i // 16
    return value


def expected(rows):
    by = defaultdict(list)
    for doc_id, source, lang, n, text in rows:
        other = leaf_of(doc_id, source, lang, n, text.lower()) if doc_id and doc_id % 5 == 0 and text else None
        by[source].append((doc_id, leaf_of(doc_id, source, lang, n, text), other))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tiers([r[1] for r in by[s]])
    above, root = tiers([trees[s][1] for s in names])
    for k, s in enumerate(names):
        for i, (doc_id, leaf, other) in enumerate(by[s]):
            proof = []
            value = folded(above, k, folded(trees[s][0], i, other or leaf, proof), proof)
            yield doc_id, leaf, trees[s][1], root, H("".join(proof)), value, value == root


def verdicts(spark, rows):
    docs = spark.createDataFrame([(*r, "k", 1, 2, "x") for r in rows], DOCS)
    hit = (F.col("doc_id") % 5 == 0) & (F.col("doc_id") != 0) & (F.col("text") != "")
    tree = merkle.manifest(merkle.leaves(docs, F.when(hit, merkle.lower_ascii(F.col("text")))))
    return sorted((tuple(r) for r in merkle.verify(tree).collect()), key=as_text)


ODD = [(5, None, None, None, "ABC é"), (None, "", "en", 3, None), (7, "", "en", 0, ""), (7, "", "en", 0, ""),
       (10, "é", "fr", -1, "X" * 50_000), (10, "é", "fr", -1, "same id"), (15, "z", "de", 2, "already lower")]


@pytest.mark.parametrize("rows", [
    ODD, ODD[:1], [(i, f"s{i:03d}", "l", i, f"T {i}") for i in range(300)],
    ODD + [(i, "hot" if i % 3 else f"s{i % 40}", "l", i, f"Text {i}") for i in range(7000)]],
    ids=["odd", "one", "sources", "subtrees"])
def test_manifest(spark, rows):
    assert verdicts(spark, rows) == sorted(expected(rows), key=as_text)


def test_manifest_of_nothing(spark):
    assert verdicts(spark, []) == []


@pytest.mark.parametrize("n", [1, 2, 15, 16])
def test_parent_resumes_states(n):
    children = [H(str(i)).encode() for i in range(n)]
    parent = merkle.Parent(children)
    assert parent.digest.decode() == H("".join(c.decode() for c in children))
    for slot in range(n):
        other = [*children[:slot], b"0" * 64, *children[slot + 1:]]
        assert parent.fold(slot, b"0" * 64) == merkle.Parent(other).digest
        assert merkle.Step(slot, parent.children).fold(b"0" * 64) == merkle.Parent(other).digest


# --- WARC -------------------------------------------------------------------------------

SPLITS = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
PAGES = [
    (None, None, None), (3, "http://User@A b\r\n.com:80/x?y#z", None), (4, "http://www.a.com/x", "é" * 50),
    (None, "u", "q" * 100), (9, "https://WWW2.A.com/x", "é" * 50), (5, "v", "é" * 49), (6, "v", "é" * 49),
    (8, "v", "q" * 100), (7, "v", "q" * 100), (7, "v", "q" * 100), (10, "", SPLITS * 9), (11, "", "long " * 60_000)]


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "d") for r in rows],
                                 "page_id long, url string, html string, seconds int, key string, digest string")


def histories(pages, archive_bytes=2000, rows=3):
    taken = warc.captures(pages, F.when(F.col("page_id") != 3, F.col("page_id") * 100_000_000_000))
    return warc.merge_histories(warc.read_archives(warc.write_archives(taken, archive_bytes)), rows)


def test_archives(spark):
    got = histories(pages_frame(spark, PAGES).repartition(3)).collect()
    first = {}
    for page, _, html in PAGES:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    want = []
    for page, _, html in PAGES:
        large = len((html or "").encode()) >= 100
        refers = first[html] if large and page != first[html] else None
        want.append((page, len((html or "").encode()), H(html or ""), "revisit" if refers else "response", refers))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in got), key=as_text) == sorted(want, key=as_text)
    order = [(r.key, r.seconds, r.page_id is not None, r.page_id or 0) for r in sorted(got, key=lambda r: r["at"])]
    assert order == sorted(order)
    by_page = {r.page_id: r for r in got}
    assert by_page[3].url == "http://User@A%20b%0D%0A.com:80/x?y#z" and by_page[3].key == "com,a%20b%0d%0a)/x?y"
    assert by_page[4].key == by_page[9].key == "com,a)/x" and by_page[9].seconds == warc.LAST_SECOND


def test_records_stand_alone_in_archives(spark):
    """Every member can be read by its offset, and only whole records lie in an archive."""
    got = histories(pages_frame(spark, PAGES)).collect()
    texts = {page: html or "" for page, _, html in PAGES}
    for r in got:
        raw = open(r.archive.removeprefix("file://"), "rb").read()[r.offset:r.offset + r.length]
        headers, block = warc.parse(zlib.decompress(raw, 31))
        assert headers["WARC-Type"] == r.record_type
        if r.record_type == "response" and r.page_id is not None:
            assert block.partition(b"\r\n\r\n")[2].decode() == texts[r.page_id]


def test_no_pages(spark):
    assert histories(pages_frame(spark, [])).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted((rnd.randrange(20), rnd.random()) for _ in range(rnd.randrange(1, 40))) for _ in range(k)]
    keys = [x for run in runs for x in run]
    ends = [sum(map(len, runs[:i + 1])) for i in range(k)]
    order = list(warc.LoserTree(keys, [0, *ends[:-1]][:k], ends))
    assert [keys[i] for i in order] == sorted(keys) and len(set(order)) == len(keys)


def test_unsorted_run_is_refused():
    with pytest.raises(ValueError):
        list(warc.LoserTree([(1,), (3,), (2,)], [0], [3]))


# --- conversation repair ----------------------------------------------------------------

def cheapest(rows):
    """Least (cost, initials) by trying every edit of every row from every state."""
    def put_in(best):
        for _ in range(3):
            for q, (cost, text) in list(best.items()):
                way = (cost + 2, text + "I")
                best[repair.PUT[q][0]] = min(way, best.get(repair.PUT[q][0], way))
        return best

    best = {0: (0, "")}
    for first, fault in rows:
        now = {}

        def take(q, way):
            now[q] = min(way, now.get(q, way))

        for q, (cost, text) in put_in(dict(best)).items():
            take(q, (cost + 3, text + "D"))
            if fault not in "bd":
                cost += fault == "t"
                if first in repair.NEXT[q]:
                    take(repair.NEXT[q][first], (cost, text + "K"))
                take(repair.PUT[q][0], (cost + 2, text + "R"))
        best = now
    best = put_in(best)
    return min(best[q] for q in (0, 3) if q in best)


def test_search_finds_the_first_cheapest_path():
    rnd = random.Random(5)
    for n in [*range(12)] * 40 + [64] * 10:
        rows = [(rnd.choice("uuaas?"), rnd.choice("....btd")) for _ in range(n)]
        assert repair.block_paths(rows, (0,), [repair.GOALS])[0][2:] == cheapest(rows), rows


def turns():
    rnd = random.Random(6)
    rows = [(None, None, None, None), (None, 1, "user", "a."), (-5, None, "user", " "), (-5, None, "", ""),
            (-6, 0, "user", "x"), (-6, 0, "user", "x"), (-6, 0, "assistant", "x."), (-8, 3, "tool", "ok. "),
            (-7, 2, "assistant", "word. " * 20_000), (-7, 0, "user", "q?")]
    rows += [(-9, i, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", f"{i}!", f"{i} b", " \n", "c?"]))
             for i in range(400)]
    return rows + [(i, j, ("user", "assistant")[j % 2], f"{i} {j}.") for i in range(40) for j in range(4)]


def whole(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        key, role, text = " " if conv is None else str(conv), role or (" " if role is None else ""), text
        text = " " if text is None else text
        n = zlib.crc32(f"{key}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(n, text)
        by[conv] += [(turn, "user" if n == 4 else role, text)] * {0: 0, 3: 2}.get(n, 1)
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in found:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else ".")
            seen.add((role, text))
        known = [t for t, _, _ in found if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:])]
        cost, audit = cheapest([(r[1][:1] or "?", f) for r, f in zip(found, faults)])
        out, state, left = [], 0, iter(found)
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(left)
            if edit == "K":
                state = repair.NEXT[state][role[0]]
            elif edit != "D":
                state, role = repair.PUT[state]
            if edit != "D":
                out.append(f"{role}:{text}")
        yield (conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("b"),
               faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
               H("\n".join(out)))


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 0) for r in rows], "conv_id long, turn long, role string, "
                                 "text string, at int, block int, fault string, copy int")


def number():
    named = F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    return F.pmod(F.crc32(named.cast("binary")), F.lit(20))


def test_repair(spark):
    got = [tuple(r) for r in repair.audit(conversations(spark, turns()), number()).collect()]
    assert sorted(got, key=as_text) == sorted(whole(turns()), key=as_text)


def test_repaired_rows_are_legal(spark):
    rows = repair.plain(conversations(spark, turns())).withColumn("copy", F.lit(0))
    final, _ = repair.repair(rows)
    by = defaultdict(list)
    for r in final.collect():
        by[r.conv].append((r["at"], r.nth, r.role))
    for found in by.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, _, role in sorted(found)))


def test_repair_of_nothing(spark):
    assert repair.audit(conversations(spark, []), number()).count() == 0
    assert [tuple(r)[:8] for r in repair.audit(conversations(spark, [(1, 0, "user", "a."), (1, 1, "assistant", "b.")])).collect()] == [
        (1, 0, 0, 0, 0, 0, 0, "KK")]
