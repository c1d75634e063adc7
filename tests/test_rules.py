"""Rules from files, linting, names, paths and three-level books against plain Python."""

import json
import random
import re

from scrivano.operators import books, lines, match, rules


def test_rules_of_a_file(spark, tmp_path):
    """Another file changes the result without a change of code; a missing one does nothing."""
    docs = spark.createDataFrame([(1, "a1 b22 cost $5\nx--y"), (2, None), (3, "")], "doc_id int, text string")
    path = tmp_path / "rules.json"
    said = {
        "safe_regex": [{"pattern": r"([a-z])(\d)", "replace": r"\2\1$", "desc": "swap"}, {"pattern": "^$", "replace": "empty"}],
        "literal": [{"from": "--", "to": "-", "desc": "dash"}, {"from": "", "to": "no"}],
        "candidate_regex": [{"pattern": r"\d+", "desc": "number"}, {"pattern": "y", "desc": ""}],
    }
    path.write_text(json.dumps(said))
    table = rules.read_rules(spark, f"file://{path}")
    done = rules.rewritten(docs, table)
    assert {r.doc_id: r.text for r in done.collect()} == {1: "1a$ 2b$2 cost $5\nx-y", 2: None, 3: "empty"}
    assert sorted((r.doc_id, r.note, r.n) for r in rules.audit(done).collect()) == [(1, "dash", 1), (1, "swap", 2), (3, "", 1)]
    found = sorted((r.doc_id, r.note, r.start, r.context) for r in rules.candidates(done, table).collect())
    want = []
    for k, text in ((1, "1a$ 2b$2 cost $5\nx-y"), (3, "empty")):
        for note, pattern in (("number", r"\d+"), ("", "y")):
            want += [(k, note, m.start(), text[max(0, m.start() - 12) : m.end() + 12].replace("\n", " ")) for m in re.finditer(pattern, text)]
    assert found == sorted(want)
    path.write_text(json.dumps({"literal": [{"from": "cost", "to": "price", "desc": "word"}]}))
    other = rules.rewritten(docs, rules.read_rules(spark, f"file://{path}"))
    assert {r.text for r in other.collect()} == {"a1 b22 price $5\nx--y", None, ""}
    none = rules.rewritten(docs, rules.read_rules(spark, f"file://{tmp_path}/missing.json"))
    assert {r.text for r in none.collect()} == {"a1 b22 cost $5\nx--y", None, ""} and rules.audit(none).count() == 0


def plain_lint(text, words):
    found = []
    for n, (_, wrong, fix, _) in enumerate(words):
        at = text.find(wrong)
        while at >= 0:
            found.append((at, at + len(wrong), n, fix))
            at = text.find(wrong, at + len(wrong))
    free, out = 0, []
    for start, end, n, fix in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        out.append((start, end, n, fix, start >= free))
        free = end if start >= free else free
    return out


def test_lint(spark):
    rng = random.Random(3)
    words = sorted([("A", "aa", "b", "m"), ("B", "aab", "", "m"), ("A", "ba", "AB", "m"), ("C", "값 값", "값", "é"), ("A", "c\nc", "cc", "m"), ("Z", "aa", "zz", "m")])
    table = spark.createDataFrame([*words, (None, None, "x", None), ("E", "", "x", "m")], "rule string, wrong string, fix string, message string")
    docs = [(k, "".join(rng.choice(["a", "a", "b", "c", "\n", "값", " ", "😀"]) for _ in range(60))) for k in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = {}
    for r in rules.lint(df, table).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.rule, r.wrong, r.fix, r.taken, r.line, r.col))
    for k, t in docs:
        want = [(s, words[n][0], words[n][1], fix, taken, t.count("\n", 0, s) + 1, s - t.rfind("\n", 0, s)) for s, _, n, fix, taken in plain_lint(t or "", words)]
        assert sorted(got.get(k, [])) == sorted(want)
    told = {r.doc_id: r.text for r in rules.fixed(df, table).collect()}
    for k, t in docs:
        out, at = "", 0
        for s, e, _, fix, taken in plain_lint(t or "", words):
            if taken:
                out, at = out + t[at:s] + fix, e
        assert told[k] == (None if t is None else out + t[at:])
    assert rules.lint(df, table.where("false")).count() == 0


def test_free_names(spark):
    rng = random.Random(4)
    stems = ["a", "a-2", "b", "c"]
    files = [(k, rng.choice(["x", "y", None]), f"old{k:03}.org" if rng.random() < 0.7 else rng.choice(stems) + ".org", rng.choice(stems) + ".org") for k in range(80)]
    files += [(200, "z", "keep", None), (201, "z", "n", "no extension"), (202, "z", "m", "no extension")]
    got = {r.id: (r.name, r.moves) for r in match.free_names(spark.createDataFrame(files, "id int, folder string, now string, want string"), "id", "folder", "now", "want").collect()}
    name = lambda want, k: want if k == 1 else re.sub(r"(\.[^./]*)?$", rf"-{k}\1", want, count=1)
    state = {}
    for k, folder, now, want in files:
        want = want or now
        twin = min((f[0] for f in files if (f[1] or "") == (folder or "") and f[2] == now))
        state[k] = [folder or "", now, want, 1, now == want and k == twin]
    while not all(s[4] for s in state.values()):
        groups = {}
        for k, s in state.items():
            groups.setdefault((s[0], name(s[2], s[3])), []).append((not s[4], s[1], k))
        for members in groups.values():
            for nth, (_, _, k) in enumerate(sorted(members)):
                if not state[k][4]:
                    state[k][3] += nth
                    state[k][4] = nth == 0
    assert got == {k: (name(s[2], s[3]), s[3]) for k, s in state.items()}
    taken = [(state[k][0], n) for k, (n, _) in got.items()]
    assert len(set(taken)) == len(taken) == len(files)


def test_paths_of_any_depth(spark):
    """A chain of a thousand, circles with tails, missing parents, repeated and null ids."""
    nodes = [(str(k), str(k - 1) if k else None, f"n{k}") for k in range(1000)]
    nodes += [("a", "b", "A"), ("b", "c", "B"), ("c", "a", "C"), ("t", "a", "T"), ("u", "t", "U"), ("s", "s", "S"), ("v", "s", "V"), ("m", "nowhere", "M"), (None, "a", "x"), ("d", "m", "D"), ("d", "m", "D"), ("e", "d", None)]
    got = {r.id: (r.depth, r.path) for r in match.category_paths(spark.createDataFrame(nodes, "id string, parent string, name string")).collect()}
    up = {}
    for k, p, n in nodes:
        if k is not None:
            up[k] = (p, n or "")
    for k in up:
        seen = [k]
        while (p := up[seen[-1]][0]) in up and p not in seen:
            seen.append(p)
        assert got[k] == (len(seen), "/".join(up[x][1] for x in reversed(seen)))
    assert len(got) == len(up)


PARTS = {"1부": "처음 부분", "2부": "나중 부분"}
TABLE = {"1강": ("하나", "1부"), "2강": ("둘", "1부"), "3강": ("셋", "2부"), "4강": ("넷", None)}


def plain_lectures(text, back, start, preface):
    first, begun = {}, set()
    for n, (_, p) in TABLE.items():
        if p and p not in begun:
            begun.add(p)
            first[n] = f"* {p} {PARTS[p]}"
    body = text.split("\n")
    at = next((i for i, x in enumerate(body) if re.match(rf"#\s+{start}\s*$", x)), 0) if start else 0
    front, body = body[:at], body[at:]
    head = lambda x: m[1].strip() if (m := re.match(r"#\s+(.*\S)\s*$", x)) else None
    out = []
    since = next((i for i, x in enumerate(front) if head(x) in preface), len(front))
    for x in front[since:]:
        out.append(x if head(x) is None else ("* " if head(x) in preface else "** ") + head(x))
    i, index = 0, False
    while i < len(body):
        x, bare = body[i], body[i].strip()
        i += 1
        if index and re.match(r"#\s+", x):
            continue
        if m := re.fullmatch(r"(?:#\s+)?(\d+강)", bare):
            out += [first[m[1]]] if m[1] in first else []
            j = next((j for j in range(i, len(body)) if body[j].strip()), None)
            title = TABLE[m[1]][0] if m[1] in TABLE else "" if j is None else re.sub(r"^#\s+", "", body[j]).strip()
            out.append(f"** {m[1]} {title}".strip())
            i = i if j is None else j + 1
            continue
        h = head(x)
        if h is None:
            out.append(x)
            continue
        if h in PARTS.values():
            ahead = next((y.strip() for y in body[i:] if re.match(r"#\s+", y) or re.fullmatch(r"\d+강", y.strip())), "")
            if re.fullmatch(r"(?:#\s+)?\d+강", ahead):
                continue
        if h in back:
            out.append(f"* {h}")
            index = h == books.INDEX
        elif re.match("[①②③④⑤⑥⑦⑧⑨⑩⑪⑫]", h) or re.match("[<〈].*[>〉]$", h) or not re.search("[가-힣]", h):
            out.append(h)
        else:
            out.append(f"*** {h}")
    return out


def test_lectures(spark):
    rng = random.Random(6)
    pieces = ["# 1강", "2강", "# 3강", " 4강 ", "9강", "# 9강", "# 처음 부분", "# 나중 부분", "# 소절 하나", "# 시작", "# 머리말", "# ABC", "# ① 항목", "# <그림>", "# 찾아보기", "# 읽을거리", "본문", "더 본문", "", "", "  ", "#", "# "]
    for seed in range(3):
        texts = [(k, "\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 40)))) for k in range(120)]
        start, preface = (None, ()) if seed == 0 else ("시작", ("머리말", "소절 하나"))
        back = ("찾아보기", "읽을거리") if seed < 2 else ("읽을거리",)
        df = lines.explode_lines(spark.createDataFrame(texts, "doc_id int, text string"))
        got = {}
        for r in sorted(books.lectures(df, PARTS, TABLE, back, start, preface).collect(), key=lambda r: (r.doc_id, r.pos, r.sub)):
            got.setdefault(r.doc_id, []).append(r.line)
        for k, t in texts:
            assert got.get(k, []) == plain_lectures(t, back, start, preface), t
