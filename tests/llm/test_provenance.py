import random

from brackenfold.llm import provenance as pv

SCHEMA = "source string, text string, chunk_index int"


def code(seed, n=30):
    r = random.Random(seed)
    names = [f"{r.choice('abcdefgh')}{r.choice('xyzuvw')}{i}" for i in range(50)]
    forms = ["let {} = {} + {};", "if {} > {} {{ return {}; }}", "{}.push({}, {});", "call_{}({}, {})", "for {} in {} {{ {} }}", "while ({} < {}) {}++;", "// the {} of {} and {}"]
    return [r.choice(forms).format(*r.sample(names, 3)) for _ in range(n)]


def reasons(spark, files):
    rows = [(s, t, i) for s, texts in files.items() for i, t in enumerate(texts if isinstance(texts, list) else [texts])]
    return {r["source"]: r["reason"] for r in pv.provenance(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_copies_across_repositories(spark):
    lib = code(1)
    adapted = lib[:10] + ["changed line here;"] + lib[11:]
    fork = code(2)
    got = reasons(
        spark,
        {
            "one/lib/zip.rs": "\n".join(lib),
            "two/src/tools.rs": "\n".join(["// " + "own header"] + ["  " + x for x in adapted]),
            "two/src/own.rs": "\n".join(code(3)),
            "three/src/a.rs": "\n".join(fork),
            "three/src/b.rs": "\n".join(fork),
            "four/vendor/x/x.rs": "\n".join(code(4)),
            "four/app/vendors/y.rs": "\n".join(code(5)),
            "four/docs/z.md": "\n".join(lib),
        },
    )
    assert got == {"one/lib/zip.rs": "vendored", "two/src/tools.rs": "vendored", "two/src/own.rs": None, "three/src/a.rs": None, "three/src/b.rs": None, "four/vendor/x/x.rs": "vendored", "four/app/vendors/y.rs": None}


def test_shared_directories(spark):
    small = {"x.rs": "fn tiny() {}", "y.rs": "mod tiny;"}
    files = {f"{repo}/pack/{f}": t for repo in ("one", "two") for f, t in small.items()} | {"three/pack/x.rs": small["x.rs"], "three/pack/other.rs": "fn other() {}"}
    got = reasons(spark, files)
    assert {s for s, r in got.items() if r} == {f"{repo}/pack/{f}" for repo in ("one", "two") for f in small}


def test_headers_and_layouts(spark):
    body = code(7)
    table = "\n".join(["static T: &[u8] = &["] + ["    0x25, 0x8f, 0x5b, 0x5d," for _ in range(20)] + ["];"])
    settings = "\n".join(f'key_{a} : {i}' for i, a in enumerate("abcdefghijkl"))
    numbered = "\n".join(f"  case {i}: m.field{i} = rd.u64({i * 7}); break;" for i in range(20))
    minified = "!function(m){iy.ky=d(yu,768),fz=i}();function(h){a.f=m(x,611),tk=m}();" * 20
    got = reasons(
        spark,
        {
            "r/a.go": "\n".join(["// SPDX-License-Identifier: X", "// Code generated by schemac v1.2. DO NOT EDIT."] + body),
            "r/b.py": "\n".join(["# Diese Datei wurde automatisch erzeugt. Nicht bearbeiten!"] + code(8)),
            "r/c.go": "\n".join(["// ids are generated in order, do not edit the order here without a test"] + code(9)),
            "r/d.go": "\n".join(code(10) + ['emit("// Code generated by schemac. DO NOT EDIT.");']),
            "r/e.go": "\n".join(["// Copyright (c) 2026 the r developers. MIT licence."] + code(11)),
            "r/f.rs": table,
            "r/g.css": settings,
            "r/h.ts": [numbered, numbered],
            "r/i.js": minified,
            "r/j.lock": "\n".join(f'  {{ "name": "n{i}", "version": "1.{i}", "checksum": "{i:064x}" }}' for i in range(9)),
            "r/k.txt": numbered,
        },
    )
    assert got == {"r/a.go": "generated", "r/b.py": "generated", "r/c.go": None, "r/d.go": None, "r/e.go": None, "r/f.rs": "data", "r/g.css": None, "r/h.ts": "generated", "r/i.js": "minified", "r/j.lock": "data"}


def test_files_of_every_kind(spark):
    made = "\n".join(["# Copyright (c) 2026 the r developers."] * 30 + ["# Code generated by schemac. DO NOT EDIT."] + code(20))
    style = "\n".join(f".box{i} {{ margin: {i * 7 % 13}px; width: {i * i}em; }}" for i in range(30))
    files = {"r/Makefile": made, "r/README": made, "one/site/a.css": style, "two/x/b.css": style}
    assert reasons(spark, files) == {"r/Makefile": "generated", "one/site/a.css": "vendored", "two/x/b.css": "vendored"}
    # the header is that of the first chunk with a text
    rows = [("r/a.go", None, 0), ("r/a.go", made, 1), ("r/a.go", "x := 1", 2), ("r/b.go", "x := 1", 0), ("r/b.go", made, 1)]
    got = {r["source"]: r["generated_header"] for r in pv.provenance(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"r/a.go": True, "r/b.go": False}


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "x", 0), ("r/a.rs", None, 0), ("r/b.rs", "", 0), ("r/b.rs", "", 0), ("plain", "x", 0), ("r/c.rs", "word " * 100_000, None)]
    got = {r["source"]: r["reason"] for r in pv.provenance(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"r/b.rs": None, "r/c.rs": None, "plain": None}
    assert pv.provenance(spark.createDataFrame([], SCHEMA)).count() == 0
    lines = "\n".join(code(12))
    extra = spark.createDataFrame([("r/a.rs", lines, 0, 5, "z")] * 2, SCHEMA + ", n_lines int, reason string")
    assert pv.provenance(extra).count() == 1
