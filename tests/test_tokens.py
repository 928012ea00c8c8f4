"""Token table, masker and taint over calls of any shape."""

from riskframe.operators.detect import engine, packs, tokens

FILES = "repo string, path string, content string"


def flows(spark, path, text):
    f = spark.createDataFrame([("r", path, text)], FILES)
    return sorted((r.pos, r.sink, r.hops) for r in packs.taint_flows(f).collect())


def masked(spark, path, text):
    out = engine.mask_comments(spark.createDataFrame([("r", path, text)], FILES)).first().code
    assert len(out) == len(text) and out.count("\n") == text.count("\n")
    return out


def test_depth_line_and_partners(spark):
    text = "f(a, {b: [1, 'x)']},\n  `t${c(1)}`) // )\n/* ( */ g = /[(/]\\// ; h(2)"
    rows = tokens.tokens(spark.createDataFrame([("r", "a.js", text)], FILES)).orderBy("i").collect()
    got = [(r.tok, r.line, r.depth) for r in rows]
    assert got == [("f", 0, 0), ("(", 0, 0), ("a", 0, 1), (",", 0, 1), ("{", 0, 1), ("b", 0, 2), ("[", 0, 2), (",", 0, 3), ("'x)'", 0, 3), ("]", 0, 2), ("}", 0, 1), (",", 0, 1),
                   ("`t${c(1)}`", 1, 1), (")", 1, 0), ("g", 2, 0), ("=", 2, 0), ("/[(/]\\//", 2, 0), (";", 2, 0), ("h", 2, 0), ("(", 2, 0), (")", 2, 0)]


def test_calls_over_lines_and_nested_arguments(spark):
    js = "function f(req) {\n  const q = 'select ' +\n    req.query.id\n  db.query(\n    wrap([1, (q)], {a: 2}),\n    1)\n  db.query('?', [q])\n  db.query(safe(1), q)\n}"
    assert flows(spark, "a.js", js) == [(3, "query", 1)]
    py = "def f():\n    a = request.args.get('q')\n    b = f'select {a}'\n    cur.execute(\n        b,\n    )\n    cur.execute('?', (a,))\n    cur.execute('b')\n"
    assert flows(spark, "a.py", py) == [(3, "execute", 2)]


def test_destructuring_and_replacement(spark):
    js = "function f(req) {\n  const { id, name: n } = req.query; let [k, m] = split(id)\n  exec(id); exec(n); exec(name)\n  exec(m)\n  n = 'safe'; exec(n)\n  if (x) id = 'safe'\n  exec(id)\n}"
    assert flows(spark, "a.js", js) == [(2, "exec", 1), (2, "exec", 1), (3, "exec", 2), (6, "exec", 1)]


def test_defaults_and_keyword_arguments_replace_nothing(spark):
    py = "def f():\n    q = request.args\n    g(q='safe')\n    cur.execute(q)\n"
    assert flows(spark, "a.py", py) == [(3, "execute", 1)]
    js = "function f(req) {\n  app.use((a) => {\n    let q = req.query.x\n    q = 'safe'\n    exec(q)\n  })\n}"
    assert flows(spark, "a.js", js) == []


def test_comments_strings_and_definitions_are_no_calls(spark):
    js = "function exec(a) {}\n// exec(req.body.a)\nlog('exec(req.body.b)'); /* eval(req.body.c)\n */ s.replace(/exec(req.body.d)/g, '')\nx.query(`${req.body.e}`)\n"
    assert flows(spark, "a.js", js) == [(4, "query", 0)]


def test_long_calls_and_many_calls(spark):
    js = "exec(" + "\n  a +" * 3000 + " [[[(req.body.x)]]])\n" + "query(b)\n" * 300
    assert flows(spark, "a.js", js) == [(0, "exec", 0)]


def test_masker_keeps_code_after_slashes(spark):
    line = 's.replace(/\\//g, "_"); app.get("/a6", h)'
    assert masked(spark, "a.js", line + " // gone") == line + "        "
    for code in ('x.split(/[/*]/); eval(req.body.code)', "<p>http://x.y</p>; g()", "t = `a ${`b // ${c}`} // d`; h()", "x = a / b; y = c / d; k()", "return /\\/\\*/.test(v) ? f() : g()"):
        assert masked(spark, "a.jsx", code + " /* gone */") == code + " " * 11
    assert masked(spark, "a.html", "<p>a</p><pre class='x'>eval(1)\n</pre><code>b</code>c") == "<p>a</p>" + " " * len("<pre class='x'>eval(1)") + "\n" + " " * len("</pre><code>b</code>") + "c"
    assert masked(spark, "run.sh", "a=$# # gone\nb='#x' c#d") == "a=$#       \nb='#x' c#d"
    assert masked(spark, "b.py", 'a = "#x" # gone\nb = """\n# kept\n"""') == 'a = "#x"       \nb = """\n# kept\n"""'


def test_no_files_and_no_sinks(spark):
    f = spark.createDataFrame([("r", "a.js", ""), ("r", "b.js", None), ("r", "c.js", "))) x = 1")], FILES)
    assert packs.taint_flows(f).count() == 0 and packs.taint_flows(f.limit(0)).count() == 0
