"""Queries of expressions: folding, evaluation, text forms, substitution, merged values, addresses, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import annotations as N
from tracewell.functions import cexpr as X
from tracewell.functions import expressions as E
from tracewell.functions import folds
from tracewell.functions import roles as R
from tracewell.functions import rules
from tracewell.functions.batches import batched, once
from tracewell.plans import contracts as C
from tracewell.plans.registry import collector
from tracewell.plans.traces import read

QUERIES, ORACLE_SQL, query = collector()

_SIGNS = ("+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>", "==", "!=", "<", "<=", ">", ">=", "&&", "||")
_TOP = "18446744073709551616::UHUGEINT"
_CASES = """c AS (SELECT o_orderkey, CAST(o_orderkey % 18 AS INT) AS k,
 CASE o_custkey % 4 WHEN 0 THEN 18446744073709551615::UHUGEINT - (o_orderkey * 7919)::UHUGEINT WHEN 1 THEN 9223372036854775807::UHUGEINT + o_orderkey::UHUGEINT WHEN 2 THEN o_orderkey::UHUGEINT ELSE o_orderkey::UHUGEINT * 4294967296::UHUGEINT END AS a,
 CASE WHEN o_orderkey % 18 IN (8, 9) THEN (o_custkey % 70)::UHUGEINT ELSE CASE o_orderkey % 5 WHEN 0 THEN 9223372036854775808::UHUGEINT + o_custkey::UHUGEINT WHEN 1 THEN 0::UHUGEINT WHEN 2 THEN 10::UHUGEINT
  WHEN 3 THEN 4611686018427387905::UHUGEINT ELSE (o_custkey * 1000003)::UHUGEINT END END AS b FROM orders)"""
_POW = "(1::UHUGEINT << CAST({} AS INT)::UHUGEINT)"
_VALUE = f"""CASE k WHEN 0 THEN (a + b) % {_TOP} WHEN 1 THEN (a + {_TOP} - b) % {_TOP} WHEN 2 THEN (a * b) % {_TOP} WHEN 3 THEN CASE WHEN b > 0 THEN a // nullif(b, 0::UHUGEINT) END WHEN 4 THEN CASE WHEN b > 0 THEN a % nullif(b, 0::UHUGEINT) END
 WHEN 5 THEN a & b WHEN 6 THEN a | b WHEN 7 THEN xor(a, b) WHEN 8 THEN CASE WHEN b >= 64 THEN 0::UHUGEINT ELSE (a % {_POW.format('64::UHUGEINT - b')}) * {_POW.format('b')} END WHEN 9 THEN CASE WHEN b >= 64 THEN 0::UHUGEINT ELSE a // {_POW.format('b')} END
 ELSE CAST(CASE k WHEN 10 THEN a = b WHEN 11 THEN a <> b WHEN 12 THEN a < b WHEN 13 THEN a <= b WHEN 14 THEN a > b WHEN 15 THEN a >= b WHEN 16 THEN a > 0 AND b > 0 ELSE a > 0 OR b > 0 END AS INT)::UHUGEINT END"""


def _operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.expr("CASE o_custkey % 4 WHEN 0 THEN cast(18446744073709551615BD - o_orderkey * 7919 AS string) WHEN 1 THEN cast(9223372036854775807BD + o_orderkey AS string) WHEN 2 THEN cast(o_orderkey AS string) ELSE cast(cast(o_orderkey AS decimal(20)) * 4294967296BD AS string) END")
    b = F.expr("CASE WHEN o_orderkey % 18 IN (8, 9) THEN cast(o_custkey % 70 AS string) ELSE CASE o_orderkey % 5 WHEN 0 THEN cast(9223372036854775808BD + o_custkey AS string) WHEN 1 THEN '0' WHEN 2 THEN '10' WHEN 3 THEN '4611686018427387905' ELSE cast(o_custkey * 1000003 AS string) END END")
    return read(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), C.pick(_SIGNS, "o_orderkey").alias("sign"), b.alias("b"))


@query(f"WITH {_CASES}, v AS (SELECT o_orderkey, a, b, k, {_VALUE} AS v FROM c) SELECT o_orderkey, CASE WHEN v IS NULL THEN '(0x' || lower(hex(a::UBIGINT)) || CASE k WHEN 3 THEN ' / ' ELSE ' % ' END || '0x0)' ELSE '0x' || lower(hex(v::UBIGINT)) END AS folded FROM v")
def const_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operands(spark, sf_dir).select("o_orderkey", X.folded_column(F.concat_ws(" ", "a", "sign", "b")).alias("folded"))


@query(f"WITH {_CASES}, v AS (SELECT o_orderkey, {_VALUE} AS v FROM c) SELECT o_orderkey, CAST(v AS VARCHAR) AS value, CASE WHEN v IS NOT NULL THEN CAST(v::HUGEINT - CASE WHEN v >= 9223372036854775808::UHUGEINT THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT) END AS bits FROM v")
def expr_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of expressions that differ by row, by the tree in Python and by the fold over tokens."""
    df = _operands(spark, sf_dir).withColumn("t", F.concat_ws(" ", "a", "sign", "b"))
    none = F.expr("cast(map() as map<string,bigint>)")
    return df.select("o_orderkey", X.value_column("t", none).alias("value"), E.evaluate(X.token_column("t"), none).alias("bits"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 1 THEN CASE WHEN l_quantity > 25 THEN l_partkey ELSE l_suppkey + 1 END ELSE (l_partkey >> 2) & 15 END AS value FROM lineitem""")
def expr_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditionals and bit ranges, compiled to column expressions."""
    env = {"q": F.col("l_quantity").cast("bigint"), "p": F.col("l_partkey"), "s": F.col("l_suppkey")}
    choice = E.compiled(X.tokens(X.parse("q > 25 ? p : s + 1")), env)
    bits = E.compiled(X.tokens(("Bits", 5, 2, ("Var", "p"))), env)
    return read(spark, sf_dir, "lineitem").select(*C.KEY, F.when(F.col("l_linenumber") % 2 == 1, choice).otherwise(bits).alias("value"))


_TEXT = "concat('(u32)dev->r', l_suppkey, ' + a * ', l_linenumber, ' == !b && ~m | BIT(3)')"


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '(((dev->r' || l_suppkey || ' + (a * 0x' || lower(hex(l_linenumber)) || ')) == (b == 0x0)) && ((m ^ 0xffffffff) | 0x8))' AS c_rules,
 '((dev->r' || l_suppkey || ' + (a * 0x' || lower(hex(l_linenumber)) || ')) == ((b == 0x0) && ((m ^ 0xffffffff) | 0x8)))' AS legacy, '(((dev->r' || l_suppkey || ' + (a * 0x' || lower(hex(l_linenumber)) || ')) == (b == 0x0)) && ((~m) | 0x8))' AS c,
 'a,b,dev->r' || l_suppkey || ',m' AS vars FROM lineitem""")
def expr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that repeat are parsed once."""
    shown = batched(lambda s: X.display(X.parse(s)), "string")
    names = lambda t: F.array_join(E.vars_in(X.token_column(t)), ",")
    rows = read(spark, sf_dir, "lineitem").select(*C.KEY, F.expr(_TEXT).alias("t"))
    return once(rows, "t", {"c_rules": shown, "legacy": X.legacy_column, "c": X.c_column, "vars": names}).drop("t")


@query("""SELECT o_orderkey, '0x10 + w->REG + ' || CASE WHEN o_orderkey % 2 = 0 THEN '0x' || lower(hex(o_custkey)) ELSE 'MISSING' END AS expanded, 'x->base + (' || o_custkey || ') + idx->base' AS substituted,
 CASE o_orderkey % 4 WHEN 0 THEN o_custkey + 1 WHEN 1 THEN o_custkey * 2 + 32 WHEN 2 THEN o_custkey END AS bound FROM orders""")
def macro_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey").cast("bigint")
    macros = F.create_map(F.lit("REG"), F.lit(16).cast("bigint"), F.lit("KEY"), k, F.lit("N_MAX"), k)
    text = F.when(F.col("o_orderkey") % 2 == 0, "REG + w->REG + KEY").otherwise("REG + w->REG + MISSING")
    names = F.create_map(F.lit("base"), F.lit("b"), F.lit("d"), F.lit("x"), F.lit("idx"), F.lit("idx"), F.lit("n"), F.concat(F.lit("("), F.col("o_custkey").cast("string"), F.lit(")")))
    wanted = C.pick(("N_CNT", "BODY", "KEY", "OTHER"), "o_orderkey")
    bodies = F.create_map(F.lit("BODY"), F.lit("(KEY + REG) * 2"), F.lit("OTHER"), F.lit("KEY + unknown"))
    return read(spark, sf_dir, "orders").select("o_orderkey", folds.with_macros(text, macros).alias("expanded"), folds.substituted(F.lit("d->base + n + idx->base"), names).alias("substituted"), X.macro_value_column(wanted, macros, bodies).alias("bound"))


_PURE = {"twice": (["x"], "x * 2"), "sum": (["a", "b"], "twice(a) + b")}


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'k + sum(1)' ELSE 'k + ((' || o_custkey || ' + 1 * 2) + (y * 2))' END AS expanded FROM orders")
def pure_call_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, "k + sum(1)").otherwise(F.concat(F.lit("k + sum("), F.col("o_custkey").cast("string"), F.lit(" + 1, twice(y))")))
    return read(spark, sf_dir, "orders").select("o_orderkey", batched(lambda t: X.expand_calls(t, _PURE), "string")(text).alias("expanded"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '(((a > ' || o_custkey || ')) ? (-EINVAL) : ((((b) && (c)) ? (x) : (0))))' WHEN o_orderkey % 4 = 2 THEN 'x' END AS returned FROM orders""")
def return_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda t, g, p=True: F.struct(F.lit(t).alias("t"), g.alias("g"), F.lit(p).alias("p"))
    none = F.expr("cast(array() as array<string>)")
    first, second = F.array(F.concat(F.lit("a > "), F.col("o_custkey").cast("string"))), F.array(F.lit("b"), F.lit("c"))
    rows = (
        F.when(F.col("o_orderkey") % 4 == 0, F.array(r("x", first), r("y", second, False), r("0", none)))
        .when(F.col("o_orderkey") % 4 == 1, F.array(r("-EINVAL", first), r("x", second), r("0", none)))
        .when(F.col("o_orderkey") % 4 == 2, F.array(r("x", first), r("x", second))).otherwise(F.array(r("x", first), r("y", second)))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", folds.returned(rows).alias("returned"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '((c' || o_custkey || ') ? (p + 4) : (p + 8))' WHEN 1 THEN '((c' || o_custkey || ') ? (p + 4) : (base + 0))' END AS pointer,
 CASE WHEN o_orderkey % 2 = 0 THEN '(((c' || o_custkey || ')) ? ((v & (~2))) : ((v | (1))))' ELSE '(((type == A) || (type == B)) ? ((v | (' || o_custkey || '))) : (0))' END AS written FROM orders""")
def assignment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    guard = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    none = F.expr("cast(array() as array<string>)")
    row = lambda t, c: F.struct(F.lit(t).alias("t"), c.alias("c"))
    twin = F.array(row("p + 4", F.array(guard)), row("p + 8", F.array(F.concat(F.lit("!("), guard, F.lit(")")))))
    rows = F.when(F.col("o_orderkey") % 3 == 0, twin).when(F.col("o_orderkey") % 3 == 1, F.array(row("base", none), row("base + 0", none), row("p + 4", F.array(guard)))).otherwise(F.array(row("p + 4", F.array(guard))))
    change = lambda op, text, guards: F.struct(F.lit(op).alias("op"), text.alias("text"), guards.alias("guards"))
    branch = folds.updated_value(F.lit("v"), F.lit(None).cast("string"), F.array(change("|=", F.lit("1"), none), change("&=", F.lit("~2"), F.array(guard))))
    one = lambda labels, op, text: F.struct(labels.alias("labels"), F.array(F.struct(F.lit(op).alias("op"), text.alias("text"))).alias("changes"))
    switch = folds.switched_value(F.lit("v"), F.lit("type"), F.array(one(F.array(F.lit("A"), F.lit("B")), "|=", F.col("o_custkey").cast("string")), one(none, "=", F.lit("0"))))
    written = F.when(F.col("o_orderkey") % 2 == 0, branch).otherwise(switch)
    return read(spark, sf_dir, "orders").select("o_orderkey", folds.pointer_value(rows).alias("pointer"), written.alias("written"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Offset' WHEN 1 THEN 'Indirect' WHEN 2 THEN 'Indirect' WHEN 3 THEN 'Fixed' WHEN 4 THEN 'Offset' ELSE 'Offset' END AS kind,
 CASE o_orderkey % 6 WHEN 0 THEN 'base' WHEN 1 THEN 'd->regs' WHEN 2 THEN 'd->base' WHEN 4 THEN 'g->base' WHEN 5 THEN 'f(' || o_custkey || ')' END AS base,
 CAST(CASE o_orderkey % 6 WHEN 0 THEN 16 + o_custkey WHEN 3 THEN o_custkey ELSE CASE WHEN o_orderkey % 6 = 4 THEN -4 ELSE 0 END END AS BIGINT) AS "offset",
 CASE o_orderkey % 6 WHEN 1 THEN '(i << ' || o_custkey || ')' WHEN 2 THEN '((c) ? (4) : (' || o_custkey || '))' END AS expr, CASE WHEN o_orderkey % 6 = 0 THEN 'REG' END AS register FROM orders""")
def address_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey").cast("string")
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    text = (
        F.when(F.col("o_orderkey") % 6 == 0, cat("base + REG + ", k)).when(F.col("o_orderkey") % 6 == 1, cat("(void *)(d->regs + (i << ", k, "))")).when(F.col("o_orderkey") % 6 == 2, cat("c ? d->base + 4 : d->base + ", k))
        .when(F.col("o_orderkey") % 6 == 3, k).when(F.col("o_orderkey") % 6 == 4, F.lit("g->base - 4")).otherwise(cat("f(", k, ")"))
    )
    none, macros = F.expr("cast(map() as map<string,string>)"), F.create_map(F.lit("REG"), F.lit(16).cast("bigint"))
    return read(spark, sf_dir, "orders").select("o_orderkey", X.address_column(text, none, macros).alias("a")).select("o_orderkey", "a.*")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'symbolic' WHEN p_size % 4 = 1 THEN 'fixed' WHEN p_size % 4 = 2 THEN 'fixed' ELSE 'computed' END AS kind, CASE WHEN p_size % 4 IN (0, 1) THEN 'g->base' WHEN p_size % 4 = 2 THEN '' ELSE 'w' END AS base,
 CASE WHEN p_size % 4 = 0 THEN 'REG' END AS register, CASE WHEN p_size % 4 > 0 THEN p_partkey END AS "offset", CASE p_size % 3 WHEN 0 THEN '0x' || lower(hex(p_partkey)) WHEN 1 THEN 'x + 1' END AS written,
 CASE p_size % 3 WHEN 0 THEN 'Fixed' WHEN 2 THEN 'Offset' END AS denotes FROM part""")
def address_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_size") % 4
    a = N.formal_address(F.when(m < 2, "Offset").when(m == 2, "Fixed").otherwise("Indirect"), F.when(m < 2, "g->base").when(m == 3, "w"), F.col("p_partkey"), F.when(m == 0, "REG"))
    tag = C.pick(("Const", "SymExpr", "BasePtr"), "p_size")
    v = N.value_address(tag, F.lit("b"), F.lit(0), F.col("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", a.alias("a"), N.value_text(tag, F.col("p_partkey"), F.lit("x + 1")).alias("written"), v["kind"].alias("denotes")).select("p_partkey", "a.*", "written", "denotes")


@query("""SELECT c_custkey, ((1::HUGEINT << CAST(c_custkey % 40 + c_nationkey % 20 + 1 AS INT)) - (1::HUGEINT << CAST(c_custkey % 40 AS INT)))::BIGINT AS mask, '/k/f.c:' || c_custkey || ':' || c_nationkey || ':7:readl' AS site,
 CASE WHEN c_custkey % 3 = 0 THEN 'tu_' || c_custkey || '_a_b' WHEN c_custkey % 3 = 1 THEN 'x_' || c_custkey ELSE 'tu_' END AS ident, c_custkey % 2 = 0 AS top, c_custkey % 3 = 0 AS lowers FROM customer""")
def expression_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    low = k % 40
    ident = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("-a.b"))).when(k % 3 == 1, F.concat(F.lit("x "), k.cast("string"))).otherwise("")
    var = lambda t, name: F.struct(F.lit(t).alias("tok"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("bigint").alias("ival"), name.alias("name"))
    tops = F.array(var("Var", F.lit("a")), F.when(k % 2 == 0, var("Top", F.lit(None).cast("string"))).otherwise(var("Var", F.lit("b"))))
    leaf = F.array(var("Var", F.when(k % 3 == 0, "g->io_base").otherwise("f(x)")))
    return c.select("c_custkey", E.genmask(low + F.col("c_nationkey") % 20, low).alias("mask"), E.site_id(F.lit("/k/f.c"), k, F.col("c_nationkey"), F.lit(7), F.lit("readl")).alias("site"), E.c_identifier(ident).alias("ident"), E.has_top(tops).alias("top"), rules.lowerable(leaf).alias("lowers"))


_FIELDS = ("irq_ack", "probe", "set_rate", "get", "nothing", "open", "suspend", "udc_start")
_FIELD_ROLE = ("interrupt_ack", "probe", "write_config", "read_config", "unknown", "init", "suspend", "init")
_FIELD_CONTEXT = ("irq", "boot", "thread", "thread", "thread", "thread", "sleepable", "thread")


@query(f"""WITH c AS (SELECT c_custkey, c_nationkey % 2 = 0 AS public, {C.sql_pick(_FIELD_ROLE, 'c_custkey')} AS r, {C.sql_pick(_FIELD_CONTEXT, 'c_custkey')} AS x FROM customer), b AS (SELECT *, CASE WHEN public THEN r ELSE 'unknown' END AS role, CASE WHEN public THEN x ELSE 'thread' END AS context FROM c)
SELECT c_custkey, role, context, public, CASE WHEN role = 'unknown' THEN CASE WHEN c_custkey % 3 = 0 THEN 'interrupt_handler' ELSE 'unknown' END ELSE role END AS function_role,
 CASE role WHEN 'interrupt_ack' THEN 'clears_interrupt(line)' WHEN 'probe' THEN 'initializes_device()' WHEN 'init' THEN 'initializes_device()' WHEN 'suspend' THEN 'suspends_device()' WHEN 'read_config' THEN 'reads_config(offset)' WHEN 'write_config' THEN 'writes_config(offset)' END AS effect,
 CASE WHEN role = 'probe' THEN 'resources_available' END AS require FROM b""")
def callback_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, field = F.when(F.col("c_nationkey") % 2 == 0, "clk_ops").otherwise("private_ops"), C.pick(_FIELDS, "c_custkey")
    r = R.field_role(table, field)
    name = F.when(F.col("c_custkey") % 3 == 0, "my_irq_handler").otherwise("do_it")
    df = read(spark, sf_dir, "customer").select("c_custkey", r.alias("r"), name.alias("name")).select("c_custkey", "r.*", "name")
    m = R.meaning(F.col("role"))
    return df.select("c_custkey", "role", "context", "public", R.function_role(F.col("name"), F.col("role"), F.col("context"), F.lit(True))["role"].alias("function_role"), m["effect"].alias("effect"), m["require"].alias("require"))


_CTYPES = ("struct irq_data *", "struct platform_device *", "unsigned int", "void", "struct foo *", "", "enum x", "void __iomem *", "const void *", "struct virtio_device")


@query(f"""SELECT c_custkey, {C.sql_pick(('LogicalIRQ', 'DeviceState', 'UInt', 'Void', 'DeviceState', 'Void', 'UInt', 'DeviceState', 'DeviceState', 'DeviceState'), 'c_custkey')} AS parameter, {C.sql_pick(('UInt', 'UInt', 'UInt', 'Void', 'UInt', 'Void', 'UInt', 'UInt', 'UInt', 'UInt'), 'c_custkey')} AS returned,
 CASE WHEN c_custkey % 10 IN (2, 3, 5, 6, 9) THEN 'candidate is not a pointer lvalue' WHEN c_custkey % 10 = 7 THEN 'typed __iomem pointer' WHEN c_nationkey % 2 = 0 THEN 'recognized MMIO base field' WHEN c_custkey % 10 = 8 THEN 'void pointer with SVF mapping provenance'
  ELSE 'aggregate/non-MMIO pointer type: ' || {C.sql_pick(_CTYPES, 'c_custkey')} END AS reason,
 CASE WHEN c_custkey % 10 = 7 THEN true WHEN c_nationkey % 3 = 0 THEN true WHEN c_nationkey % 3 = 1 THEN false ELSE true END AS provenance FROM customer""")
def type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.pick(_CTYPES, "c_custkey")
    name = F.when(F.col("c_nationkey") % 2 == 0, "dev->regs").otherwise("dev->other")
    params = F.array(F.struct(F.lit("p").alias("name"), t.alias("ctype")))
    address = F.when(F.col("c_nationkey") % 3 == 0, "p->my.regs + 4").when(F.col("c_nationkey") % 3 == 1, "p + 4").otherwise("global_base")
    return read(spark, sf_dir, "customer").select("c_custkey", R.parameter_type(t).alias("parameter"), R.return_type(t).alias("returned"), R.mapped_lvalue(name, t)["reason"].alias("reason"), R.has_provenance(address, params).alias("provenance"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'CONFIG_' || p_partkey ELSE 'MY_REG' END AS name, p_size % 2 = 0 AS noise FROM part")
def noise_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("CONFIG_"), F.col("p_partkey").cast("string"))).otherwise("MY_REG")
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), rules.is_noise(name, R.NOISE_PREFIXES).alias("noise"))
