"""A token table of source texts: one row a token, from one pass, with bracket depth by running sums.

Comments, strings, templates and regular expressions are tokens of their own, so nothing inside them is taken for code. A call is
the interval between a bracket and its partner; what a token belongs to (the arguments of a call, the right-hand side of an
assignment) is read off at every bracket level around it, by windows inside one file. Texts of any length and calls over any
number of lines are treated alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..core import cut_lineage
from . import rules as R
from .engine import REGEX_LITERAL, TEMPLATE, has_any, matches, newlines

# Lexical forms of the two comment styles.
_STRINGS = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_CHAIN = r"[A-Za-z_$][\w$]*+(?:\s*+\??\.\s*+[A-Za-z_$][\w$]*+)*+"
_SIGNS = r"=>|[=!]==?|<=|>=|\+=|[-*/%&|^:]=|=|[(){}\[\],;]"
C_TOKEN = r"(?s)//[^\n]*+|/\*.*?\*/|" + _STRINGS + "|" + TEMPLATE + "|" + REGEX_LITERAL + "|" + _CHAIN + "|" + _SIGNS
HASH_TOKEN = (r"(?s)#[^\n]*+|[A-Za-z]{0,2}(?:\"\"\".*?\"\"\"|'''.*?'''|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')|"
              + _CHAIN.replace("$", "") + "|" + _SIGNS)
KEYWORDS = ("const let var function async await return new typeof if else for while in of def class import from as export default try except catch "
            "finally with lambda not and or is None True False null undefined true false this self").split()
SINK_NAMES = ("exec", "execSync", "eval", "query", "execute", "system", "fetch", "redirect")
_MARK = "struct<at:int,name:string,line:int,end:boolean>"
_TARGET = "struct<at:int,var:string,line:int,conditional:boolean,plus:boolean>"


def tokens(files: DataFrame, keep=()) -> DataFrame:
    """tokens(repo, path, *keep, i, tok, gap, line, depth): ``gap`` is the text before the token (white space, numbers, other operators), ``line``
    counts from 0, ``depth`` is that of the brackets around the token; a bracket and its partner have the same. Comments are left out."""
    text, py = F.col("content"), F.endswith("path", F.lit(".py"))
    found = files.select("repo", "path", *keep, F.posexplode_outer(F.when(py, matches(text, HASH_TOKEN)).otherwise(matches(text, C_TOKEN))).alias("i", "m"))
    rows = found.filter("m.hits IS NOT NULL").select("repo", "path", *keep, "i", F.ltrim("m.hits").alias("tok"), F.col("m.gaps").alias("gap"))
    head, last = F.substring("tok", 1, 1), F.substring("tok", -1, 1)
    quoted = last.isin("'", '"')
    # n name or chain, t template with code in it, s string, o and c brackets, x comment, others as they are
    rows = rows.withColumn("cls", F.when(head.isin("(", "[", "{"), "o").when(head.isin(")", "]", "}"), "c").when(head == "`", "t").when(quoted & head.rlike("[A-Za-z]") & F.contains(F.lower(F.substring("tok", 1, 2)), F.lit("f")), "t").when(quoted, "s")
                           .when((head == "#") | F.substring("tok", 1, 2).isin("//", "/*"), "x").when(head.rlike(r"[A-Za-z_$]"), "n").otherwise(head))
    upto = W.partitionBy("repo", "path").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.when(F.col("cls") == "o", 1).when(F.col("cls") == "c", -1).otherwise(0)
    return (rows.withColumn("line", (F.sum(newlines(F.col("gap")) + newlines(F.col("tok"))).over(upto) - newlines(F.col("tok"))).cast("int"))
            .withColumn("depth", (F.sum(step).over(upto) - F.when(step == 1, 1).otherwise(0)).cast("int"))
            .filter("cls <> 'x'"))


def _inner(tok: Column) -> Column:
    """The code in the interpolations of a template."""
    return F.array_join(F.regexp_extract_all(tok, F.lit(r"\{([^{}]*)\}"), F.lit(1)), " ")


def _refs() -> Column:
    """Names that a token reads: the root of a chain, or those in the interpolations of a template."""
    names = F.regexp_extract_all(F.regexp_replace(_inner(F.col("tok")), r"'[^']*'|\"[^\"]*\"", ""), F.lit(r"(?<![\w$.])([A-Za-z_$][\w$]*)"), F.lit(1))
    return F.when(F.col("cls") == "n", F.array(F.regexp_extract("tok", r"^([A-Za-z_$][\w$]*)", 1))).when(F.col("cls") == "t", names).otherwise(F.array().cast("array<string>"))


def _reads_request() -> Column:
    chain = F.concat(F.regexp_replace("tok", r"\s|\?", ""), F.when(F.col("nxt").isin("[", "("), F.col("nxt")).otherwise(""))
    hinted = has_any(F.col("tok"), ("req", "searchParams", "nextUrl", "params", "query", "body", "ctx", "user"))
    return F.coalesce(F.when(hinted & F.col("cls").isin("n", "t"), F.when(F.col("cls") == "t", _inner(F.col("tok"))).otherwise(chain).rlike(R.REQUEST)), F.lit(False))


def statements(files: DataFrame, sinks=SINK_NAMES) -> DataFrame:
    """levels(repo, path, scope, i, depth, level, refs, source, call, arg, target, closed, name): every token that counts, once for each bracket level
    around it. ``call`` is the bracket open at that level with the sink it belongs to (``name``, null for other brackets), ``arg`` the number of
    commas before the token in it, ``target`` the assignment whose right-hand side holds the token."""
    here = W.partitionBy("repo", "path").orderBy("i")
    candidates = files.filter(F.col("content").rlike(r"\b(?:" + "|".join(sinks) + r")\s*\("))
    t = tokens(candidates.withColumn("_unpacks", F.col("content").rlike(r"[}\]]\s*=(?![=>])")), ["_unpacks"])
    tok, gap = F.col("tok"), F.col("gap")
    last_name = F.regexp_extract("prev", r"([\w$]+)$", 1)
    blank = F.trim(F.translate(gap, "\n\r\t", "   ")) == ""
    t = (t.withColumn("prev", F.lag("tok").over(here)).withColumn("prev2", F.lag("tok", 2).over(here)).withColumn("prev3", F.lag("tok", 3).over(here)).withColumn("nxt", F.lead("tok").over(here)).withColumn("nxt2", F.lead("tok", 2).over(here))
         .withColumn("nxt_gap", F.lead("gap").over(here)).withColumn("new_line", (F.col("line") > F.coalesce(F.lag("line").over(here), F.lit(-1))) & F.contains("gap", F.lit("\n")) | F.col("prev").isNull())
         .withColumn("_start", (tok.rlike(r"^(?:async|function|def|export)$") & (F.col("depth") == 0) & F.col("new_line") & ~gap.rlike(r"[ \t]$")).cast("int"))
         .withColumn("scope", F.sum("_start").over(here.rowsBetween(W.unboundedPreceding, W.currentRow)))
         .withColumn("_indent", F.last(F.when(F.col("new_line"), F.length(F.regexp_replace(F.regexp_extract("gap", r"([ \t]*)$", 1), "\t", "    "))), True).over(here.rowsBetween(W.unboundedPreceding, W.currentRow))))
    opens, closes, cls = F.col("cls") == "o", F.col("cls") == "c", F.col("cls")
    t = t.withColumn("_before", F.lag("cls").over(here)).withColumn("_after", F.lead("cls").over(here))
    assigns = tok.isin("=", "+=", ":=")
    # A new line ends a statement unless an operator or a comma carries it on; in brackets only of blocks.
    ends = (tok == ";") | (tok == ",") & (F.col("_after") == "n") & (F.col("nxt2") == "=") | F.col("new_line") & blank & cls.isin("n", "s", "t") & ~F.coalesce(F.col("prev").isin(",", "=", "(", "[", "+=", ":=", "=>"), F.lit(False))
    plain_name = (F.col("_before") == "n") & ~F.contains("prev", F.lit(".")) & ~F.col("prev").isin(*KEYWORDS)
    before = F.when(F.col("prev2").isin("const", "let", "var"), F.col("prev3")).otherwise(F.col("prev2"))
    # Nested deeper than a function's own statements, or after a condition without braces: it may not happen.
    conditional = (tok == "+=") | (F.col("_indent") >= 8) | (F.coalesce(before, F.lit(";")) == ")") & ~F.col("_opened")
    t = t.withColumn("_opened", F.coalesce(F.lag("new_line").over(here), F.lit(True)))

    def at(level, order, **own):
        base = {"open": F.lit(None).cast(_MARK), "comma": F.lit(0), "mark": F.lit(None).cast(_TARGET), "isref": F.lit(False), "sign": F.lit(None).cast("string")} | own
        return F.struct(level.cast("int").alias("level"), F.lit(order).alias("o"), *[v.alias(k) for k, v in base.items()])
    depth = F.col("depth")
    sink = F.when((tok == "(") & (F.col("_before") == "n") & blank & last_name.isin(*sinks) & ~F.coalesce(F.col("prev2").isin("function", "def"), F.lit(False)), last_name)
    var = F.when(plain_name, F.col("prev"))
    group = F.array(
        F.when(opens, at(depth, 1, open=F.struct(F.col("i").alias("at"), sink.alias("name"), F.col("line"), F.lit(False).alias("end")).cast(_MARK))),
        F.when(opens, at(depth + 1, 1, sign=tok)),
        F.when(closes, at(depth, 1, open=F.struct(F.col("i").alias("at"), F.lit(None).cast("string").alias("name"), F.col("line"), F.lit(True).alias("end")).cast(_MARK))),
        F.when(closes, at(depth + 1, 1, mark=F.struct(F.col("i").alias("at"), F.lit(None).cast("string").alias("var"), F.col("line"), F.lit(False).alias("conditional"), F.lit(False).alias("plus")).cast(_TARGET))),
        F.when(tok == ",", at(depth - 1, 1, comma=F.lit(1))),
        F.when(ends, at(depth, 0, mark=F.struct(F.col("i").alias("at"), F.lit(None).cast("string").alias("var"), F.col("line"), F.lit(False).alias("conditional"), F.lit(False).alias("plus")).cast(_TARGET))),
        F.when(assigns & (plain_name | F.col("prev").isin("}", "]")), at(depth, 2, mark=F.struct(F.col("i").alias("at"), F.coalesce(var, F.lit("")).alias("var"), F.col("line"), conditional.alias("conditional"), (tok == "+=").alias("plus")).cast(_TARGET))))
    t = t.withColumn("refs", _refs()).withColumn("source", _reads_request())
    is_ref = (F.size("refs") > 0) & ~tok.isin(*KEYWORDS) & ~F.coalesce((F.col("nxt") == "=") | (F.col("nxt") == "+="), F.lit(False)) | F.col("source")
    levels = F.when(is_ref, F.transform(F.sequence(F.least(F.lit(0), depth), depth), lambda l: at(l, 1, isref=F.lit(True)))).otherwise(F.array())
    named = F.when((cls == "n") & ~F.contains("tok", F.lit(".")) & ~F.coalesce(F.ltrim("nxt_gap"), F.lit("")).startswith(":") & F.col("_unpacks"), tok)
    rows = (t.select("repo", "path", "scope", "i", "depth", "line", "refs", "source", named.alias("name"), F.concat(F.filter(group, lambda x: x.isNotNull()), levels).alias("_m"))
            .select("repo", "path", "scope", "i", "depth", "line", "refs", "source", "name", F.explode_outer("_m").alias("m")).filter("m IS NOT NULL").select("*", "m.*").drop("m"))
    w = W.partitionBy("repo", "path", "level").orderBy("i", "o")
    upto, past = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, -1)
    # Inside a call or an index an assignment names an argument or a default: it replaces nothing.
    inside = F.coalesce(F.last("sign", True).over(upto), F.lit("{"))
    rows = rows.withColumn("_inside", inside).withColumn("mark", F.when(F.col("mark").isNotNull(), F.col("mark").withField("conditional", F.col("mark.conditional") | (F.col("_inside") != "{"))))
    out = (rows.withColumn("call", F.last("open", True).over(upto)).withColumn("_was", F.last("open", True).over(past)).withColumn("_commas", F.sum("comma").over(upto)).withColumn("target", F.last("mark", True).over(upto))
           .withColumn("arg", (F.col("_commas") - F.coalesce(F.last(F.when(F.col("open").isNotNull(), F.col("_commas")), True).over(upto), F.lit(0))).cast("int"))
           .withColumn("closed", F.last(F.when(F.col("open.end"), F.col("_was.at")), True).over(upto)))
    return out.select("repo", "path", "scope", "i", "depth", "level", "isref", "refs", "source", "name", "call", "arg", "target", "closed", F.col("mark.at").alias("mark_at"), (F.col("open.name").isNotNull()).alias("opens_sink"))


def events(files: DataFrame, sinks=SINK_NAMES) -> DataFrame:
    """events(repo, path, scope, at, pos, kind, var, call, refs, source, conditional): assignments and sink calls in order (``at``: number of the token,
    ``pos``: line from 0). The refs of a sink are those of its first argument, over any number of lines and nested brackets; an assignment to
    ``{a, b}`` or ``[a, b]`` is one to each name."""
    s = statements(files, sinks)
    none, no = F.array().cast("array<string>"), F.lit(False)

    def row(kind, at, var, pos, conditional, refs, source):
        return F.struct(F.lit(kind).alias("kind"), at.alias("at"), var.alias("var"), pos.alias("pos"), conditional.alias("conditional"), refs.alias("refs"), source.alias("source"))
    call, target, marked = F.col("call"), F.col("target"), F.coalesce((F.col("mark_at") == F.col("target.at")) & F.col("target.var").isNotNull(), no)
    in_call = F.col("isref") & call["name"].isNotNull() & (F.col("arg") == 0) & (F.col("level") < F.col("depth"))
    own = F.array(
        F.when(in_call, row("sink", call["at"], call["name"], call["line"], no, F.col("refs"), F.col("source"))),
        F.when(F.col("isref") & target["var"].isNotNull(), row("assign", target["at"], target["var"], target["line"], target["conditional"], F.col("refs"), F.col("source"))),
        F.when(F.col("opens_sink"), row("sink", call["at"], call["name"], call["line"], no, none, no)),
        F.when(marked, row("assign", target["at"], target["var"], target["line"], target["conditional"], none, no)),
        # {a, b} = ...: names directly inside the bracket that closes before the sign
        F.when(marked & (target["var"] == "") & F.col("closed").isNotNull(), row("pattern", target["at"], F.lit(""), F.col("closed"), no, none, no)),
        F.when(F.col("isref") & F.col("name").isNotNull() & (F.col("depth") == F.col("level") + 1), row("name", call["at"], F.col("name"), call["at"], no, none, no)))
    rows = cut_lineage(s.select("repo", "path", "scope", F.explode(F.filter(own, lambda x: x.isNotNull())).alias("e")).select("repo", "path", "scope", "e.*"))
    got = (rows.filter("kind IN ('sink', 'assign')").groupBy("repo", "path", "kind", "at", "var", "pos", "conditional")
           .agg(F.min("scope").alias("scope"), F.array_distinct(F.flatten(F.collect_list("refs"))).alias("refs"), F.bool_or("source").alias("source")))
    pattern = rows.filter("kind = 'pattern'").select("repo", "path", "at", F.col("pos").alias("_open"))
    names = rows.filter("kind = 'name'").select("repo", "path", F.col("at").alias("_open"), F.col("var").alias("name"))
    taken = pattern.join(names, ["repo", "path", "_open"]).select("repo", "path", "at", "name").distinct()
    several = got.filter("kind = 'assign' AND var = ''").join(taken, ["repo", "path", "at"]).withColumn("var", F.col("name")).select(got.columns)
    every = got.filter("var <> ''").unionByName(several)
    return every.select("repo", "path", "scope", "at", "pos", "kind", "var", F.when(F.col("kind") == "sink", F.col("at")).otherwise(0).alias("call"), "refs", "source", "conditional")
