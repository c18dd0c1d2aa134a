import hashlib
import random

from quern.llm.handwritten import composition, not_handwritten

LOCATIONS = "id bigint, repo_root string, path string, start_line int, end_line int, content_hash string, node_type string, node_name string, language string, created_at bigint"
CHUNKS = "chunk_id bigint, repo_root string, path string, start_line int, content string, content_hash string, extra int"


def code(seed, lines=40):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta kappa sigma omega theta".split()) + r.choice("Row Cell Node Edge Tree".split())
    return "\n".join(f"    {word()}{r.randrange(99)} = {word()}.{word()}({word()}, {r.randrange(999)})" for _ in range(lines))


def test_files(spark):
    library = "// fastlib 1.4.2\n// Released under a licence.\n" + code(1)
    patched = code(1).split("\n")
    patched[5:8] = ["    local patch here that nobody else has"]
    files = {
        ("r1", "node_modules/fastlib/a.js"): library,
        ("r2", "src/util/renamed.js"): "\n".join(patched),
        ("r3", "lib/generated/hand.js"): "// Not generated: written by hand.\n" + code(2),
        ("r4", "lib/hand.js"): code(2),
        ("r1", "gen/a.go"): "// Code generated by tool v1.2. DO NOT EDIT.\n" + code(3),
        ("r1", "tools/gen.go"): code(4, 20) + '\n  banner = "// Code generated by tool. DO NOT EDIT."\n' + code(5, 20),
        ("r1", "fields.py"): "\n".join(f"    m.Field{n:04d} = buf[{n * 8}]" for n in range(60)),
        ("r1", "dist/app.js"): "!function(a){return a.b}(c);" * 300,
        ("r1", "table.ts"): "const T = [\n" + "\n".join(",".join(str((n * 7919 + m) % 1000) for m in range(16)) + "," for n in range(40)) + "\n];",
        ("r1", "conf/data.json"): "\n".join(f'  "k{n}": {n},' for n in range(60)),
        ("r1", "README.md"): "# fastlib 1.4.2\n" + code(1),
    }
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    locations = [(n, r, p, 1, 9, digest(t), "block", None, "go", 1) for n, ((r, p), t) in enumerate(files.items())]
    locations += [(90, "r9", "copied/elsewhere.js", 1, 9, "SHA256:" + digest(library).upper(), None, None, None, None), (91, "r9", "x.go", 1, 9, None, None, None, None, None), (92, None, "x.go", 1, 9, "ab", None, None, None, None)] + locations[:2]
    chunks = [(n, r, p, 1, t, digest(t), 0) for n, ((r, p), t) in enumerate(files.items())] + [(99, "r1", "e.go", 1, None, None, 0), (98, "r1", "e.go", None, "", digest(""), 0)]
    ldf, cdf = spark.createDataFrame(locations, LOCATIONS), spark.createDataFrame(chunks, CHUNKS)
    got = {(r.repo_root, r.path): r.reason for r in not_handwritten(ldf, cdf).collect()}
    assert got == {
        ("r1", "node_modules/fastlib/a.js"): "vendored", ("r2", "src/util/renamed.js"): "vendored", ("r9", "copied/elsewhere.js"): "vendored",
        ("r1", "gen/a.go"): "generated", ("r1", "fields.py"): "generated", ("r1", "dist/app.js"): "minified", ("r1", "table.ts"): "data",
    }
    assert not_handwritten(ldf.limit(0), cdf).collect() == [] and not_handwritten(ldf, cdf.limit(0)).collect() == []


def _reasons(spark, files):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    locations = [(n, r, p, 1, 9, digest(t), "block", None, "go", 1) for n, ((r, p), t) in enumerate(files.items())]
    chunks = [(n, r, p, 1, t, digest(t), 0) for n, ((r, p), t) in enumerate(files.items())]
    return {(r.repo_root, r.path): r.reason for r in not_handwritten(spark.createDataFrame(locations, LOCATIONS), spark.createDataFrame(chunks, CHUNKS)).collect()}


def test_files_that_come_with_a_library(spark):
    patched = code(12).split("\n")
    patched[5:8] = ["    local patch here that nobody else has"]
    files = {}
    for n in range(4):
        files[f"r{n}", f"deps{n}/main.js"] = "// fastlib 1.4.2\n" + code(11)
        files[f"r{n}", f"deps{n}/tree.js"] = code(12)
    files["r5", "src/other.js"] = "\n".join(patched)
    # written by hand: beside the library by chance, and copied
    for r, p in [("r0", "deps0/own.js"), ("r1", "deps1/own.js"), ("r5", "src/own.js"), ("r6", "src/own.js")]:
        files[r, p] = code(13)
    files["r2", "deps2/alone.js"] = code(14)
    assert set(_reasons(spark, files)) == {(f"r{n}", f"deps{n}/{f}.js") for n in range(4) for f in ("main", "tree")} | {("r5", "src/other.js")}


def test_library_under_two_names_and_in_a_bundle(spark):
    licence = "\n".join(f"// permission number {w} is granted as follows" for w in "one two three four five six".split())
    files = {
        ("r1", "a.js"): "// fastlib 1.4.2\n" + code(21),
        ("r2", "b.js"): "// fastlib-core 1.4.3\n" + code(21),
        ("r3", "all.js"): "// bigbundle 2.0.0\n" + code(22) + "\n" + code(23),
        ("r3", "part.js"): "// partlib 2.0.0\n" + code(22),
        ("r4", "copy.js"): code(21),
        ("r4", "part.js"): code(22),
        ("r5", "one.js"): "// onelib 1.0.0\n" + licence + "\n" + code(24),
        ("r6", "two.js"): "// twolib 1.0.0\n" + licence + "\n" + code(25),
        # half licence, which says nothing: the copied rest decides
        ("r7", "mine.js"): licence + "\n" + code(26, 6),
        ("r7", "theirs.js"): licence + "\n" + "\n".join(code(24).split("\n")[:4] + code(27, 3).split("\n")),
    }
    got = set(_reasons(spark, files))
    assert {("r4", "copy.js"), ("r4", "part.js"), ("r7", "theirs.js")} <= got and ("r7", "mine.js") not in got


def test_patched_copies_with_one_and_with_two_banners(spark):
    def patched(n):
        lines = code(41, 60).split("\n")
        lines[n : n + 3] = [f"    local patch number {n} of this repository only"]
        return "\n".join(lines)

    copies = {(f"r{n}", f"src/d{n}/copy.js"): patched(3 * n) for n in range(7)}
    first = copies | {("r8", "deps/fast.js"): "// fastlib 1.4.2\n" + code(41, 60)}
    assert set(_reasons(spark, first)) == set(first)
    second = first | {("r9", "deps/other.js"): "// otherlib 2.0.1\n" + code(41, 60) + "\n" + code(42, 30)}
    assert set(_reasons(spark, second)) == set(second)
    # without any banner nothing tells a library from code that people copied
    assert _reasons(spark, copies) == {}


def test_tables_written_by_hand(spark):
    files = {
        ("r", "a_test.py"): "def test_add():\n" + "\n".join(f"    assert add({n}, {n + 1}) == {2 * n + 1}" for n in range(12)),
        ("r", "b.spec.ts"): "\n".join(f"  expect(area{n}({n})).toBe({n * n});" for n in range(20)),
        ("r", "prices.go"): "\n".join(f"\taddPrice(\"apple\", {n * 3}, {n})" for n in range(20)),
        ("r", "gen.go"): "\n".join(f"\tset_field_{n}(m, {n})" for n in range(20)),
    }
    assert _reasons(spark, files) == {("r", "gen.go"): "generated"}


LICENCE = [f"Permission line {w} of a licence header" for w in "one two three four five six seven eight".split()]


def test_banners_anywhere_in_the_leading_comment():
    head = lambda mark: "\n".join(f"{mark} {x}" for x in LICENCE)
    generated = lambda text, first=True: composition(text, first)[5]
    library = lambda text: composition(text, True)[6]
    assert generated(head("//") + "\n// Code generated by tool. DO NOT EDIT.\npackage x\n" + code(1))
    assert generated("/*\n" + head(" *") + "\n * This file was automatically generated.\n */\nint x;\n")
    assert not generated(head("//") + "\npackage x\n// Code generated by tool. DO NOT EDIT.\n" + code(1))
    assert library("/*!\n * fastlib v1.4.2\n * MIT\n */\n" + code(1)) == "fastlib"
    assert library("#!/usr/bin/env node\n// fastlib 1.4.2\n" + code(1)) == "fastlib"
    assert library("<?php\n/**\n * fastlib 1.4.2 (MIT)\n */\n" + code(1)) == "fastlib"
    assert library("// Copyright 2020 the authors\n// fastlib 1.4.2\n" + code(1)) == "fastlib"
    for text in ("// Our parser.\n// Version 1.4.2\n", "# Loader\n# Python 3.11.2\n", "// Note\n// fastlib 1.4.2 breaks this\n", "// Note\nx = 1\n// fastlib 1.4.2\n"):
        assert library(text + code(1)) is None


def test_leading_comment_of_several_chunks(spark):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    notice = "// More of it.\n// Code generated by tool. DO NOT EDIT.\npackage x\n" + code(31)
    parts = [("a.go", 1, "\n".join(f"// {x}" for x in LICENCE)), ("a.go", 9, notice), ("b.go", 1, "package y\n" + code(32)), ("b.go", 50, notice)]
    locations = [(n, "r", p, s, s + 8, digest(t), "block", None, "go", 1) for n, (p, s, t) in enumerate(parts)]
    chunks = [(n, "r", p, s, t, digest(t), 0) for n, (p, s, t) in enumerate(parts)]
    got = not_handwritten(spark.createDataFrame(locations, LOCATIONS), spark.createDataFrame(chunks, CHUNKS)).collect()
    assert [(r.path, r.reason) for r in got] == [("a.go", "generated")]


def test_composition_of_long_text():
    lines, chars, blanks, *_ = composition("x = 1\n" * 50000, True)
    assert lines == 50000 and chars == 300000 and blanks == 150000
