"""Secret scan and web archives against brute force and round trips."""

import base64
import hashlib
import io
import random
import re
import zipfile

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from textlake.llm import warc
from textlake.llm.secrets import ENDPOINT, KEY40, PARTNERS, USER, scan
from textlake.session import shared_dir

# --- secrets -----------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ORDER = ("assign", "access", "hex", "user", "key40", "endpoint")
ROLE = dict(zip(ORDER, ("secret", "identifier", "secret", "identifier", "secret", "endpoint"), strict=True))


def all_parts(t):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    out += [("user", m.start(), m.end()) for m in re.finditer(USER, t, re.A)]
    out += [("key40", m.start(), m.end()) for m in re.finditer(KEY40, t, re.A)
            if len(m[0]) == 40 and all(re.search(p, m[0]) for p in ("[A-Z]", "[a-z]", "[0-9]"))]
    out += [("endpoint", m.start(), m.end()) for m in re.finditer(ENDPOINT, t, re.A)]
    return out


def test_a_part_does_not_complement_what_it_lies_in(spark):
    run = "0123456789abcdef" * 2
    texts = [f"https://cdn.example.org/{run}/logo.png", f"https://cdn.example.org/logo.png {run}", f"{run} then postgres://db.example.org/x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [p["kind"] for p in r.parts] for r in scan(docs).collect()}
    assert got == {0: ["hex"], 1: ["endpoint", "hex"], 2: ["hex", "endpoint"]}


def reported(t, scope):
    parts = all_parts(t)

    def near(p, q):
        starts, ends = p[2] <= q[1] <= p[2] + scope, max(p[1] - scope, 0) <= q[2] <= p[1]
        return starts or ends

    keep = [p for p in parts if p[0] in ORDER[:3] or any(ROLE[q[0]] in PARTNERS[ROLE[p[0]]] and near(p, q) for q in parts)]
    return sorted((s, ORDER.index(k), k, e) for k, s, e in keep)


def texts():
    r = random.Random(9)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    bits = [lambda: "password=" + hexes(18), lambda: f'TOKEN = "{hexes(40)}"', lambda: "secret:short", lambda: "token:secret:abcdefghijk",
            lambda: "AKIA" + "".join(r.choice("ABCDEFGH234567") for _ in range(r.choice([5, 12, 16]))), lambda: "bob.smith@mail.example.com",
            lambda: "user: alice_1", lambda: "https://api.example.com/v1?x=1", lambda: "host=db.internal:5432",
            lambda: "Ab1" + "".join(r.choice("abcXYZ019/+") for _ in range(37)), lambda: hexes(31), lambda: "é日\U0001F600",
            lambda: "word " * r.randrange(80), lambda: "\x01\x02"]
    rows = [(i, " ".join(r.choice(bits)() for _ in range(r.randrange(9)))) for i in range(150)]
    many = " ".join(f"a{i}@b.example.com" for i in range(3000)) + " " * 500 + "password=abcdefgh1"
    return rows + [(150, None), (151, ""), (3, rows[3][1]), (None, rows[4][1]), (None, None), (152, many), (153, "token=" + "x" * 100_000)]


def test_secret_scan(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kind string, start int")
    for scope in (40, 200):
        got = scan(docs, scope=scope).collect()
        want = [(i, reported(t or "", scope)) for i, t in rows]
        assert sorted(((r.doc_id, [(p["start"], p["order"], p["kind"], p["end"]) for p in r.parts]) for r in got), key=repr) == sorted(want, key=repr)
        for r in got:
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(p["kind"] == k for p in r.parts) for k in ORDER[:3]]
    assert any(p[2] in ORDER[3:] for _, w in want for p in w)  # some weak parts are linked, others are not
    assert sum(len(w) for _, w in want) < sum(len(all_parts(t or "")) for _, t in rows)
    assert scan(docs.where("false")).count() == 0


# --- archives ------------------------------------------------------------------

def pages():
    r = random.Random(2)
    rows = [(i, f"https://h/{i}", r.choice(["", "same", "é" * r.randrange(50), f"<p>{i}</p>" * r.randrange(200)])) for i in range(120)]
    return rows + [(120, None, None), (5, "other", rows[5][2]), (None, "u", "nobody else's"), (None, "u", "same"), (121, "a\r\nb", "x" * 300_000)]


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "page_id long, url string, html string, sha int, package int")
    written = warc.write_packages(df, records_per_package=25, salts=4)
    got = warc.read_packages(written, run=7).collect()
    assert written.count() > 3
    lead = {}
    for i, _, html in rows:
        if i is not None:
            lead[html or ""] = max(i, lead.get(html or "", -1))
    want = []
    for i, _, html in rows:
        p = (html or "").encode()
        revisit = html is not None and i != lead.get(html, i) or html is None and i != lead.get("", i)
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response",
                     lead.get(html or "") if revisit else None, None if revisit else p))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
    assert sorted(r.url for r in got if r.page_id == 121) == ["a b"]
    folder = written.first().path.rsplit("/", 1)[0]
    listed = warc.read_packages(warc.list_packages(spark, folder), with_payload=False)
    assert listed.count() == len(rows) and listed.where("payload is not null").count() == 0


def test_html_is_dealt_once(spark):
    df = spark.createDataFrame([(1, "u", "x"), (2, "v", "x"), (2, "v", "x"), (None, None, "x"), (None, "w", "y")],
                               "page_id long, url string, html string")
    rows = df.withColumns({"sha": F.unhex(F.sha1("html")), "salt": F.lit(0)})
    lead = rows.groupBy("sha", "salt").agg(F.max("page_id").alias("lead"))
    out = warc.dealt_pages(rows, lead, 3)
    assert sorted(((r.page_id, r.url, r.html, r.refers_to) for r in out.collect()), key=repr) == sorted(
        [(1, "u", "x", "2"), (2, "v", "x", None), (2, "v", "x", None), (None, None, "x", "2"), (None, "w", "y", None)], key=repr)
    # neither side of the join has the texts
    sides = [n for n in plan_nodes(out._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    assert sides and not any("html" in side.output().mkString(",") for j in sides for side in (j.left(), j.right()))


def plan_nodes(node):
    children = node.children()
    return [node] + [n for i in range(children.size()) for n in plan_nodes(children.apply(i))]


def test_packages_are_plain_zip_files(spark):
    df = spark.createDataFrame([(1, "u", "x"), (2, "v", "x")], "page_id long, url string, html string")
    path = warc.write_packages(df).first().path
    store, name = warc.open_fs(path)
    with zipfile.ZipFile(io.BytesIO(store.open_input_file(name).read())) as z:
        assert z.namelist() == [warc.DATA, warc.INDEX] and z.testzip() is None
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_packages(warc.write_packages(df)).count() == 0


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 in a comment"])
def test_central_directory(tmp_path, comment):
    names = [f"m{i}" for i in range(70_000)] if not comment else ["a", "b"]  # beyond 65,535 members: ZIP64
    path = str(tmp_path / "x.zip")
    with zipfile.ZipFile(path, "w") as z:
        for n in names:
            with z.open(zipfile.ZipInfo(n), "w", force_zip64=n in ("a", "m7")) as f:
                f.write(n.encode())
        z.comment = comment
    with fs.LocalFileSystem().open_input_file(path) as f:
        members = warc.central_directory(f, path)
        assert set(members) == set(names)
        for n in names[:: max(1, len(names) // 50)]:
            at, size = warc.member_range(f, path, members[n])
            assert f.read_at(size, at) == n.encode()


def test_broken_packages(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 1000)], "page_id long, url string, html string")
    store, name = warc.open_fs(warc.write_packages(df, shared_dir(spark, "broken")).first().path)
    data = store.open_input_file(name).read()
    for k, bad in enumerate((data[:-30], data[:200] + bytes(80) + data[280:], b"", b"PK")):
        path = str(tmp_path / f"{k}.wacz")
        (tmp_path / f"{k}.wacz").write_bytes(bad)
        with pytest.raises(Exception, match=f"{k}.wacz"):
            warc.read_packages(spark.createDataFrame([(path,)], "path string")).collect()
    with pytest.raises(ValueError, match="compressed"):
        warc.member_range(pa.BufferReader(b""), "p", (8, 1, 0))
