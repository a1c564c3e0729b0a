"""Build sources: macro definitions, compile databases, and the flags that a parser needs.

Everything is a column expression but the two parts that Spark cannot say: splitting a
shell command, and parsing an expression that is more than a literal.
"""

from __future__ import annotations

import re
import shlex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import expressions as E
from tracewell.functions.batches import batched

#: Fixed by the command lines: flags followed by a path, prefixes of paths, flags and prefixes kept as they are.
PATH_FLAGS = ("-I", "-isystem", "-include", "-imacros", "-iquote", "-idirafter")
PATH_PREFIXES = ("-isystem", "-include", "-imacros", "-iquote", "-idirafter", "-I")
KEPT_FLAGS = ("-nostdinc", "-nostdinc++", "-fshort-wchar", "-funsigned-char", "-fms-extensions", "-fno-common", "-fno-strict-aliasing", "-m32", "-m64")
KEPT_PREFIXES = ("-D", "-U", "-std=", "-fstrict-flex-arrays=", "--target=")

_OBJECT = r"(?U)^\s*#\s*define\s+([A-Za-z_]\w*)\s+(.+?)\s*(?:/\*.*)?$"
_FUNCTION = r"(?U)^\s*#\s*define\s+([A-Za-z_]\w*)\(([^)]*)\)\s+(.+?)\s*(?:/\*.*)?$"
_SUFFIX = r"\b(0[xX][0-9a-fA-F]+|[0-9]+)(?:[uU][lL]{0,2}|[lL]{1,2}[uU]?)\b"
_ENTRIES = "array<struct<directory:string,file:string,command:string,arguments:array<string>>>"


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def int_literal(text: Column) -> Column:
    """Value of an integer literal, of BIT(n), (1 << n) or ~0; null for anything else.

    Suffixes go, values beyond 63 bits become their bit pattern, and ~0 counts as 32 ones.
    """
    return E.let(F.trim(F.regexp_replace(text, _SUFFIX, "$1")), _literal)


def _literal(t: Column) -> Column:
    shift = E.let(F.coalesce(_group(t, r"(?i)^BIT\s*\(\s*([0-9]+)\s*\)$", 1), _group(t, r"^\(\s*1\s*<<\s*([0-9]+)\s*\)$", 1)).try_cast("int"), lambda n: E.shift_left(F.lit(1), n))
    ones = F.when(t.rlike(r"^~\s*(0[xX]0+|0+)$"), F.lit(0xFFFFFFFF))
    hexa = F.conv(_group(t, r"^[+-]?0[xX]([0-9a-fA-F]{1,16})$", 1), 16, -10).try_cast("bigint")
    deci = _group(t, r"^[+-]?(0+|[1-9][0-9]*)$", 1).try_cast("bigint")
    is_shift = t.rlike(r"^(?i:BIT\s*)?\(")
    return F.when(is_shift, shift).otherwise(F.coalesce(ones, F.coalesce(hexa, deci) * F.when(t.startswith("-"), -1).otherwise(1)))


def _tokens(text: str | None):
    # a decimal with leading zeros is no number of a definition
    return None if text is None or re.search(r"(?<![\w.])0[0-9]", text) else E.parse(text)


def int_value(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the value of a constant integer expression; null if it reads a name or divides."""
    t = F.trim(F.regexp_replace(F.col(text), _SUFFIX, "$1"))
    t = F.coalesce(_group(t, r"(?i)^HSOTG_REG\s*\((.+)\)$", 1), t)
    parsed = batched(_tokens, f"array<{E.TOKEN}>")(F.when(int_literal(t).isNull(), t))
    out = df.withColumn("_tok", parsed)
    constant = ~F.exists("_tok", lambda x: (x["tok"] == "Var") | ((x["tok"] == "Op") & (x["op"] == "Div")))
    value = F.when(constant, E.evaluate(F.col("_tok"), F.expr("cast(map() as map<string,bigint>)")))
    return out.withColumn(name, F.coalesce(int_literal(t), value)).drop("_tok")


def defines(lines: DataFrame, key: str, line_no: str = "line_no", text: str = "text") -> DataFrame:
    """(key, line_no, name, params, body, value) of the macro definitions among lines.

    Those without parameters are kept only if their body is a constant integer; those with
    parameters have no value. Lines that define nothing, and null ones, are left out.
    """
    t = F.col(text)
    call = _group(t, _FUNCTION, 1)
    plain = F.when(call.isNull(), _group(t, _OBJECT, 1))
    params = F.when(call.isNotNull(), F.filter(F.transform(F.split(F.regexp_extract(t, _FUNCTION, 2), ","), lambda p: F.trim(p)), lambda p: p != ""))
    found = lines.select(key, line_no, F.coalesce(call, plain).alias("name"), params.alias("params"), F.when(call.isNotNull(), F.regexp_extract(t, _FUNCTION, 3)).otherwise(F.regexp_extract(t, _OBJECT, 2)).alias("body"))
    return int_value(found.where("name IS NOT NULL"), "body", "_v").select(key, line_no, "name", "params", "body", F.when(F.col("params").isNull(), F.col("_v")).alias("value")).where("params IS NOT NULL OR value IS NOT NULL")


def normal_path(path: Column, directory: Column) -> Column:
    """An absolute path without ``.``, ``..`` and double slashes; a relative one starts at the directory."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", directory, path))
    step = lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(full, "/"), F.expr("cast(array() as array<string>)"), step), "/"))


def _flag_path(value: Column, directory: Column) -> Column:
    """A flag's path: relative ones start at the directory; absolute, empty and symbolic ones stay."""
    return F.when(value.rlike(r"^($|[$</])"), value).otherwise(normal_path(value, directory))


def parser_flags(tokens: Column, directory: Column, source: Column) -> Column:
    """The language and preprocessor flags of a command, with absolute paths.

    A flag that takes the next token is held until that token is seen, so one without a
    next token is dropped. C is the language unless the command names one, and the folder
    of the source is searched last unless it is searched already.
    """
    none = F.lit(None).cast("string")
    empty = F.expr("cast(array() as array<string>)")

    def step(s: Column, t: Column) -> Column:
        prefix = F.coalesce(*[F.when(t.startswith(p) & (t != p), F.lit(p)) for p in PATH_PREFIXES])
        kept = t.isin(*KEPT_FLAGS)
        for p in KEPT_PREFIXES:
            kept = kept | t.startswith(p)
        held = s["held"].isNotNull()
        waits = ~held & t.isin("-x", *PATH_FLAGS)
        add = (
            F.when(held, F.array(s["held"], F.when(s["held"] == "-x", t).otherwise(_flag_path(t, directory))))
            .when(waits, empty)
            .when(prefix.isNotNull(), F.array(F.concat(prefix, _flag_path(F.substring(t, F.length(prefix) + 1, F.length(t)), directory))))
            .when(kept, F.array(t)).otherwise(empty)
        )
        return F.struct(F.concat(s["out"], add).alias("out"), F.when(waits, t).otherwise(none).alias("held"))

    start = F.struct(empty.alias("out"), none.alias("held"))
    out = F.aggregate(tokens, start, step, lambda s: s["out"])
    folder = F.regexp_replace(normal_path(source, F.lit("/")), "/[^/]*$", "")
    language = F.when(F.array_contains(out, "-x"), empty).otherwise(F.array(F.lit("-x"), F.lit("c")))
    searched = F.array_contains(out, folder) | F.array_contains(out, F.concat(F.lit("-I"), folder))
    return F.concat(language, out, F.when(searched, empty).otherwise(F.array(F.lit("-I"), folder)))


def _split(command: str | None) -> list[str] | None:
    try:
        return None if command is None else shlex.split(command)
    except ValueError:  # an open quote
        return None


def compile_commands(files: DataFrame, text: str = "text", directory: str = "directory") -> DataFrame:
    """(source, tokens, directory, command_sha256) of the entries of compile databases, one row per source: its first entry.

    ``directory`` names the column with the folder of the file, for entries without their own. Texts that
    are not such a database give no rows; an entry whose command has an open quote has null tokens.
    """
    entries = files.select(F.col(directory).alias("_d"), F.posexplode(F.from_json(F.col(text), _ENTRIES)).alias("_i", "_e"))
    home = F.coalesce(F.nullif(F.col("_e.directory"), F.lit("")), F.col("_d"))
    raw = F.coalesce(F.array_join(F.col("_e.arguments"), "\0"), F.col("_e.command"), F.lit(""))
    each = entries.select("_d", "_i", normal_path(F.coalesce(F.col("_e.file"), F.lit("")), home).alias("source"), home.alias("directory"), F.col("_e.arguments").alias("_a"), F.col("_e.command").alias("_c"), F.sha2(raw, 256).alias("command_sha256"))
    first = each.groupBy("source").agg(F.min_by(F.struct("_a", "_c", "directory", "command_sha256"), F.struct("_d", "_i")).alias("f")).select("source", "f.*")
    split = batched(_split, "array<string>")
    return first.select("source", F.coalesce("_a", split(F.when(F.col("_a").isNull(), F.coalesce("_c", F.lit(""))))).alias("tokens"), "directory", "command_sha256")


def manifests(files: DataFrame, key: str, text: str = "text", directory: str = "directory", least: int = 4) -> DataFrame:
    """(key, name, sources, build_file, problem) of manifests of several sources; paths start at the folder in ``directory``.

    ``problem`` is the first that holds of ``not a manifest``, ``schema``, ``name``, ``too few
    sources`` (fewer than ``least``) and ``not C``; null for a manifest that is fine.
    """
    m = F.from_json(F.col(text), "schema int, name string, sources array<string>, kbuild string")
    paths = F.transform("_m.sources", lambda s: normal_path(s, F.col(directory)))
    problem = (
        F.when(F.col("_m.sources").isNull(), "not a manifest").when(~F.col("_m.schema").eqNullSafe(F.lit(1)), "schema").when(F.coalesce(F.col("_m.name"), F.lit("")) == "", "name")
        .when(F.size("_m.sources") < least, "too few sources").when(~F.forall("_m.sources", lambda s: F.coalesce(s.endswith(".c"), F.lit(False))), "not C")
    )
    read = files.select(key, directory, m.alias("_m"))
    return read.select(key, F.col("_m.name").alias("name"), paths.alias("sources"), F.when(F.col("_m.kbuild").isNotNull(), normal_path(F.col("_m.kbuild"), F.col(directory))).alias("build_file"), problem.alias("problem"))
