"""Facts of programs on contract tables of parsed rows: functions, calls, variables, bindings, macros.

A parser outside this engine supplies the rows. The tables are: functions (symbol, name,
source, line, is_definition, is_static), call_sites (caller, callee, symbol, line,
offset), variables (unit, name, ctype, is_global), macros (unit, name, value, raw, ord),
bindings (symbol, function, table, field, role, context, source, line, column). Each
operator is a filter, one join on equal keys or one aggregation by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import accesses as A
from tracewell.functions import roles as R
from tracewell.functions.expressions import c_identifier
from tracewell.sources.builds import int_literal, normal_path

#: Compiler-visible helpers of registration, which are no functions of a driver.
REGISTRATION_HELPERS = ("__inittest", "__exittest")
#: What in a symbol's text says that it comes from a mapping call.
MAPPING_WORDS = ("ioremap", "pci_ioremap_bar", "devm_ioremap", "pci_iomap", "of_iomap")


# ---------------------------------------------------------------- scans


def target_functions(functions: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Functions that are defined in their target file, without registration helpers."""
    return functions.where(F.col("is_definition") & (F.col(source) == F.col(target)) & ~F.col("name").isin(*REGISTRATION_HELPERS))


def ordered_calls(call_sites: DataFrame, function: list[str]) -> DataFrame:
    """Call sites numbered in source order (``call_no`` from 1) within their function."""
    return call_sites.withColumn("call_no", F.row_number().over(Window.partitionBy(*function).orderBy("offset", "line", "callee")))


def mapped_globals(variables: DataFrame) -> DataFrame:
    """File-scope variables whose type is a mapped pointer or a void pointer."""
    t = F.coalesce("ctype", F.lit(""))
    return variables.where(F.col("is_global") & (t.contains("__iomem") | (t.endswith("*") & t.contains("void"))))


def preprocessor_macros(records: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, name, value, raw, params) of preprocessing records: each name's first definition; function-like ones have params and no value."""
    first = records.groupBy(*unit, "name").agg(F.min_by(F.struct("raw", "params"), "ord").alias("f"))
    return first.select(*unit, "name", F.when(F.col("f.params").isNull(), int_literal(F.col("f.raw"))).alias("value"), F.col("f.raw").alias("raw"), F.col("f.params").alias("params"))


def resolved_sources(requests: DataFrame, key: str) -> DataFrame:
    """(key, sources, name, descriptor, problem) of what an extraction is asked for.

    ``requests`` has one of ``source`` (a path), ``source_list`` (paths) and ``manifest``
    (the text of a manifest, its path in ``source``), the working folder ``cwd`` and an
    optional ``driver_name``. Paths of a manifest start at its folder. The name is the one
    asked for, else the manifest's, else the first source's stem.
    """
    m = F.from_json("manifest", "sources array<string>, name string")
    absolute = lambda p, d: normal_path(p, d)
    path = absolute(F.col("source"), F.col("cwd"))
    folder = F.regexp_replace(path, "/[^/]*$", "")
    sources = F.when(F.col("manifest").isNotNull(), F.transform(m["sources"], lambda s: absolute(s, folder))).when(F.col("source_list").isNotNull(), F.transform("source_list", lambda s: absolute(s, F.col("cwd")))).otherwise(F.array(path))
    name = F.nullif(F.coalesce(F.nullif(F.col("driver_name"), F.lit("")), F.when(F.col("manifest").isNotNull(), m["name"]).otherwise(F.regexp_replace(F.regexp_extract(F.get("_s", 0), "[^/]*$", 0), r"(?<=.)\.[^.]*$", ""))), F.lit(""))
    descriptor = F.when(F.col("manifest").isNotNull() | F.col("source_list").isNull(), path).otherwise(F.array_join("_s", ";"))
    problem = (
        F.when(F.col("manifest").isNotNull() & m["sources"].isNull(), "manifest lacks sources").when(F.size("_s") == 0, "at least one source is required").when(F.col("manifest").isNotNull() & F.col("_n").isNull(), "manifest lacks name")
    )
    out = requests.withColumn("_s", sources).withColumn("_n", name)
    return out.select(key, F.col("_s").alias("sources"), F.col("_n").alias("name"), descriptor.alias("descriptor"), problem.alias("problem"))


def compile_contexts(sources: DataFrame, databases: DataFrame, kbuild: DataFrame, mode: str = "auto") -> DataFrame:
    """(source, command, origin, problem): of each source the command of its compile database, else of its saved build command.

    ``databases`` and ``kbuild`` have (source, command); the latter's is null where the file
    has none. Mode ``off`` looks nowhere; ``required`` reports a source without either.
    """
    if mode == "off":
        return sources.select("source", F.lit(None).cast("string").alias("command"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("problem"))
    d = databases.select("source", F.col("command").alias("_d")).where("_d IS NOT NULL")
    k = kbuild.select("source", F.col("command").alias("_k")).where("_k IS NOT NULL")
    got = sources.select("source").join(d, "source", "left").join(k, "source", "left")
    origin = F.when(F.col("_d").isNotNull(), "compile-commands").when(F.col("_k").isNotNull(), "kbuild-cmd")
    problem = F.when(origin.isNull() & (F.lit(mode) == "required"), "no compile context found")
    return got.select("source", F.coalesce("_d", "_k").alias("command"), origin.alias("origin"), problem.alias("problem"))


# ---------------------------------------------------------------- calls


def access_sites(call_sites: DataFrame, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """The register accesses among call sites, one row per site_id: the first in ``ord``, with kind, domain, width, status, reason.

    Needs callee, call_text, site_id, ord.
    """
    name = A.effective_name(F.col("callee"), F.col("call_text"))
    s = call_sites.withColumn("access", name).withColumn("access_kind", A.kind(F.col("access"))).where("access_kind IS NOT NULL")
    listed = F.col("callee").isin(*blacklist) if blacklist else F.lit(False)
    status = F.when(listed, "filtered").when(F.col("access_kind") == "unsupported", "unsupported").otherwise("pending")
    reason = F.when(status == "filtered", "explicit extractor blacklist").when(status == "unsupported", "recognized register API lacks scalar RIS model")
    first = first_rows(s, ["site_id"], ["ord"])
    return first.select("*", A.domain(F.col("access")).alias("access_domain"), A.width(F.col("access")).alias("width"), status.alias("initial_status"), reason.alias("reason"))


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row in order of each key. Rows are pre-aggregated before the shuffle, so a hot key costs one row a task."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_f")).select("_f.*")


def accounted(sites: DataFrame, ops: DataFrame, key: str = "site_id", op_id: str = "op_id") -> DataFrame:
    """Sites with status emitted (and their sorted operations), filtered, unsupported or unaccounted, and the reason."""
    found = ops.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(op_id)).alias("ris_ops"))
    emitted = F.col("ris_ops").isNotNull()
    status = F.when(emitted, "emitted").when(F.col("initial_status") == "pending", "unaccounted").otherwise(F.col("initial_status"))
    reason = F.when(~emitted, F.when(F.col("initial_status") == "pending", "recognized source MMIO call produced no RIS op").otherwise(F.col("reason")))
    return sites.join(found, key, "left").withColumns({"status": status, "reason": reason, "ris_ops": F.coalesce("ris_ops", F.array().cast(ops.select(F.collect_set(op_id)).schema[0].dataType))})


def without_evidence(ops: DataFrame, key: str = "site_id") -> DataFrame:
    """Register operations that name no site; state operations may go without one."""
    return ops.where(F.col(key).isNull() & F.col("kind").isin("Read", "Write", "ReadModifyWrite"))


def wrapper_summaries(functions: DataFrame, call_sites: DataFrame) -> DataFrame:
    """(symbol, name, kind, width, address, value) of functions whose only register call is unguarded and of a mapped address.

    ``call_sites`` has (caller, callee, args, control): the guards around the call.
    ``functions`` has (symbol, name, params).
    """
    name, args = F.col("callee"), F.col("args")
    k = A.kind(name)
    calls = call_sites.select("caller", k.alias("kind"), name.alias("callee"), args.alias("args"), F.coalesce(F.size("control"), F.lit(0)).alias("_c")).where(F.col("kind").isin("read", "write"))
    one = calls.groupBy("caller").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("kind", "callee", "args", "_c")).alias("c")).where("_n = 1 AND c._c = 0")
    w = A.write_parts(F.col("c.callee"), F.col("c.args"))
    address = F.when(F.col("c.kind") == "read", A.read_address(F.col("c.callee"), F.col("c.args"))).otherwise(w["address"])
    got = functions.join(one, F.col("symbol") == F.col("caller")).withColumn("address", address)
    return got.where(R.has_provenance(F.col("address"), F.col("params"))).select(
        "symbol", "name", F.initcap("c.kind").alias("kind"), A.width(F.col("c.callee")).alias("width"), "address", F.when(F.col("c.kind") == "write", w["value"]).alias("value")
    )


def indirect_targets(assignments: DataFrame, functions: DataFrame) -> DataFrame:
    """(key, function): what a call through a field can only mean.

    ``assignments`` are (root, field, function) of table initialisers and member
    assignments. Keys are root.field, root->field and the bare field; a key counts if just
    one known function is assigned to it.
    """
    known = assignments.join(functions.select(F.col("name").alias("function")).distinct(), "function", "left_semi")
    keys = F.array(F.concat_ws(".", "root", "field"), F.concat_ws("->", "root", "field"), F.col("field"))
    each = known.select(F.explode(keys).alias("key"), "function")
    return each.groupBy("key").agg(F.min("function").alias("function"), F.max("function").alias("_x")).where("function = _x").drop("_x")


def resolved_calls(call_sites: DataFrame, targets: DataFrame) -> DataFrame:
    """``call_sites`` (callee_text, callee) with ``resolved``: the target of the whole text, else of its last member; null without."""
    text = F.regexp_replace(F.coalesce("callee_text", F.lit("")), r"\s+", "")
    last = F.when(text == "", F.col("callee")).otherwise(F.regexp_extract(text, r"(?:^|->|\.)((?:(?!->|\.).)*)$", 1))
    a = targets.select(F.col("key").alias("_k1"), F.col("function").alias("_f1"))
    b = targets.select(F.col("key").alias("_k2"), F.col("function").alias("_f2"))
    got = call_sites.withColumns({"_t": text, "_m": last}).join(a, F.col("_t") == F.col("_k1"), "left").join(b, F.col("_m") == F.col("_k2"), "left")
    return got.withColumn("resolved", F.coalesce("_f1", "_f2")).select(*call_sites.columns, "resolved")


# ---------------------------------------------------------------- names, bindings, specifications


def module_names(functions: DataFrame, driver: str) -> DataFrame:
    """``functions`` with ``module_name`` and ``duplicate_externals``.

    A name that one function has, or that of an external function, stays. Static functions
    that share a name get file stem and name, numbered from 2 on among equal ones in order
    of source and line, past names that are taken. Several external functions of one name
    are an error of the program; they are marked, not renamed.
    """
    by_name = Window.partitionBy(driver, "name")
    shared = F.count(F.lit(1)).over(by_name)
    stem = F.regexp_replace(F.regexp_extract("source", "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    base = F.concat(c_identifier(stem), F.lit("__"), c_identifier(F.col("name")))
    w = functions.withColumns({"_s": shared, "_e": F.count_if(~F.col("is_static")).over(by_name)}).withColumn("_b", F.when(F.col("is_static") & (F.col("_s") > 1), base))
    taken = w.where("_b IS NULL").select(driver, F.col("name").alias("_b")).distinct().withColumn("_taken", F.lit(1))
    w = w.join(taken, [driver, "_b"], "left").withColumn("_k", F.row_number().over(Window.partitionBy(driver, "_b").orderBy("source", "line", "name")) + F.coalesce("_taken", F.lit(0)))
    name = F.when(F.col("_b").isNull(), F.col("name")).when(F.col("_k") == 1, F.col("_b")).otherwise(F.concat("_b", F.lit("__"), F.col("_k").cast("string")))
    return w.select(*functions.columns, name.alias("module_name"), (F.col("_e") > 1).alias("duplicate_externals"))


def register_maps(ops: DataFrame, macros: DataFrame, driver: str) -> DataFrame:
    """(driver, name, offset, width): the registers that operations name, with the width of the first and the macro's offset."""
    first = ops.where("reg_name IS NOT NULL AND reg_name <> ''").groupBy(driver, F.col("reg_name").alias("name")).agg(F.coalesce(F.min_by("width", "ord"), F.lit(4)).alias("width"))
    return first.join(macros.where("value IS NOT NULL").select(driver, "name", F.col("value").alias("offset")), [driver, "name"]).select(driver, "name", "offset", "width")


def function_specs(modules: DataFrame, functions: DataFrame, bindings: DataFrame, entries: DataFrame) -> DataFrame:
    """(module, symbol, role, context, callback_table, is_entry, effect, ensure, require) of modules whose function is known.

    ``modules`` has (module), ``functions`` (symbol, name, module_name), ``bindings`` the
    primary one of each symbol, ``entries`` the symbols of callback entries.
    """
    b = bindings.select("symbol", F.col("role").alias("_r"), F.col("context").alias("_c"), F.concat_ws(".", "table", "field").alias("callback_table"))
    f = modules.join(functions, F.col("module") == F.coalesce("module_name", "name")).join(b, "symbol", "left").join(entries.select("symbol").distinct().withColumn("_e", F.lit(True)), "symbol", "left")
    entry = F.coalesce("_e", F.lit(False))
    spec = f.withColumn("_s", R.function_role(F.col("name"), F.col("_r"), F.col("_c"), entry)).withColumn("_m", R.meaning(F.col("_s.role")))
    return spec.select("module", "symbol", "_s.role", "_s.context", "callback_table", entry.alias("is_entry"), "_m.effect", "_m.ensure", "_m.require")


def binding_report(bindings: DataFrame, entries: DataFrame) -> DataFrame:
    """``bindings`` (all of them, alternates too) with ``entry``: bound if the symbol is a callback entry; unbound entries have no binding."""
    e = entries.select("symbol").distinct().withColumn("_e", F.lit(True))
    got = bindings.join(e, "symbol", "full_outer")
    state = F.when(F.col("function").isNull(), "unbound").when(F.col("_e"), "bound")
    return got.select(*bindings.columns, state.alias("entry"))


def bind_lookup(wanted: DataFrame, table: DataFrame, on: list[str], value: str) -> DataFrame:
    """``wanted`` with ``value`` of the first row (by ``ord``) of a backend's table with the same ``on`` columns; null without."""
    first = table.groupBy(*on).agg(F.min_by(value, "ord").alias(value))
    return wanted.join(first, on, "left")


def mapping_origins(symbols: DataFrame, globals_: DataFrame) -> DataFrame:
    """Symbols whose text comes from a mapping call or contains the name of a known global.

    Names are identifiers, so one is in a text if it is a part of some word of it. Parts of
    the words of distinct texts are joined with the names, of which there may be any number.
    """
    words = symbols.select("ir").where("ir IS NOT NULL").distinct().select("ir", F.explode(F.array_distinct(F.regexp_extract_all("ir", F.lit(r"\w+"), F.lit(0)))).alias("_w"))
    parts = F.expr("array_distinct(flatten(transform(sequence(1, length(_w)), i -> transform(sequence(1, length(_w) - i + 1), n -> substr(_w, i, n)))))")
    named = words.select("ir", F.explode(parts).alias("name")).join(globals_.select("name").distinct(), "name", "left_semi").select("ir").distinct().withColumn("_named", F.lit(True))
    return symbols.join(named, "ir", "left").where(F.coalesce(F.col("ir").rlike("|".join(MAPPING_WORDS)), F.lit(False)) | F.coalesce("_named", F.lit(False))).select(*symbols.columns)


def base_expressions(ops: DataFrame, module: list[str]) -> DataFrame:
    """(module, base) for every base of a module's symbolic addresses, and the variable before its member."""
    dev = ops.where((F.col("addr_kind") == "symbolic") & (F.coalesce("device", F.lit("")) != ""))
    owner = F.nullif(F.regexp_extract("device", r"^([A-Za-z_]\w*)->\w+$", 1), F.lit(""))
    return dev.select(*module, F.explode(F.filter(F.array("device", owner), lambda x: x.isNotNull())).alias("base")).distinct()


def bound_resources(summaries: DataFrame, driver: str) -> DataFrame:
    """(driver, base, resource_index): the index that the first entry naming a base has.

    ``summaries`` has ``fields``: a map of arrays of (base, resource_index), and ``ord``.
    """
    e = summaries.select(driver, "ord", F.explode("fields").alias("_k", "_v")).select(driver, "ord", "_k", F.posexplode("_v").alias("_i", "e"))
    e = e.where(F.col("e.base").rlike(r"^[A-Za-z_]\w*$"))
    return e.groupBy(driver, F.col("e.base").alias("base")).agg(F.min_by("e.resource_index", F.struct("ord", "_k", "_i")).alias("resource_index"))


def clock_groups(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, table, fields): the members that each clock table of a source sets; of a member set twice the last holds."""
    tables = F.regexp_extract_all(text, F.lit(r"\b(?:static\s+)?(?:const\s+)?struct\s+clk_ops\s+[A-Za-z_]\w*\s*=\s*\{[^{}]*\}"), F.lit(0))
    one = r"\.([A-Za-z_]\w*)\s*=\s*&?\s*([A-Za-z_]\w*)"
    pairs = F.transform(F.regexp_extract_all("_t", F.lit(one), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, one, 1).alias("k"), F.regexp_extract(x, one, 2).alias("v")))
    last = F.aggregate(pairs, F.expr("cast(array() as array<struct<k:string,v:string>>)"), lambda a, p: F.concat(F.filter(a, lambda q: q["k"] != p["k"]), F.array(p)))
    t = files.select(key, F.explode(tables).alias("_t"))
    return t.select(key, F.regexp_extract("_t", r"struct\s+clk_ops\s+([A-Za-z_]\w*)", 1).alias("table"), F.map_from_entries(last).alias("fields")).where("size(fields) > 0")


def device_facts(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, includes, error_paths, helper_calls, resources) of a source text; resources are the acquisition calls in it, in a fixed order."""
    t = F.col(text)
    error = r"return\s+(-(?:ENOMEM|ENODEV|ENXIO|EINVAL|ENOTSUPP|EIO|EBUSY|EAGAIN|EFAULT|ENOSYS|ERANGE|ENOSPC)|PTR_ERR\([^)]*\))"
    paths = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(error), F.lit(1)), lambda e: F.concat(F.lit("return "), e))))
    present = lambda names, test: F.filter(F.array(*[F.when(test(n), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return files.select(
        key, F.regexp_extract_all(t, F.lit(r'(?m)^\s*#\s*include\s+[<"]([^>"]+)[>"]'), F.lit(1)).alias("includes"), paths.alias("error_paths"),
        present(sorted(HELPER_CALLS), lambda n: t.contains(n)).alias("helper_calls"), present(RESOURCE_CALLS, lambda n: t.rlike(rf"\b{n}\s*\(")).alias("resources"),
    )


#: Calls that acquire a resource, and calls of subsystems worth naming.
RESOURCE_CALLS = (
    "devm_platform_ioremap_resource", "devm_ioremap_resource", "devm_ioremap", "devm_request_mem_region", "platform_get_resource",
    "devm_clk_get_enabled", "devm_clk_get", "clk_get", "platform_get_irq", "devm_request_irq",
)
HELPER_CALLS = (
    "devm_gpiochip_add_data", "gpiochip_add_data", "bgpio_init", "platform_driver_register", "platform_driver_unregister", "virtio_device_ready",
    "register_virtio_device", "virtio_add_status", "virtio_finalize_features", "devm_regmap_init_mmio", "clk_prepare_enable", "clk_disable_unprepare",
)


def device_constants(macros: DataFrame, registers: DataFrame, referenced: DataFrame, driver: str) -> DataFrame:
    """(driver, name, value) of the constants that matter for a device.

    They are neither registers nor noise, do not start with an underscore, and are
    referenced or share the prefix of a register or of the driver's name.
    """
    prefix = lambda c: F.upper(F.substring_index(c, "_", 1))
    own = F.upper(F.regexp_extract(driver, "^[A-Za-z0-9]*", 0))
    known = registers.select(driver, prefix(F.col("name")).alias("_p")).union(registers.select(driver, own.alias("_p"))).where("_p <> ''").distinct().withColumn("_k", F.lit(True))
    used = referenced.select(driver, "name").distinct().withColumn("_u", F.lit(True))
    from tracewell.functions.rules import is_noise

    m = macros.where("value IS NOT NULL AND NOT startswith(name, '_')").where(~is_noise(F.col("name"), R.NOISE_PREFIXES)).join(registers.select(driver, "name"), [driver, "name"], "left_anti")
    return m.withColumn("_p", prefix(F.col("name"))).join(known, [driver, "_p"], "left").join(used, [driver, "name"], "left").where("_k OR _u").select(driver, "name", "value")


def recipe_issues(cases: DataFrame, recipes: DataFrame, profiles: DataFrame) -> DataFrame:
    """(case_id, issue) of recipes held against the frozen cases.

    ``cases`` has (case_id, source), ``recipes`` (case_id, profile, target), ``profiles``
    (profile). The target of a recipe is its case's source with the suffix ``.o``.
    """
    j = cases.join(recipes.withColumn("_r", F.lit(1)), "case_id", "full_outer").join(profiles.select("profile").distinct().withColumn("_p", F.lit(1)), "profile", "left")
    expected = F.regexp_replace("source", r"(?<=[^/])\.[^./]*$", ".o")
    issues = F.array(
        F.when(F.col("_r").isNull(), F.lit("case without a recipe")), F.when(F.col("source").isNull(), F.lit("recipe without a case")),
        F.when(F.col("_r").isNotNull() & F.col("_p").isNull(), F.concat(F.lit("missing profile "), F.coalesce("profile", F.lit("None")))),
        F.when(F.col("_r").isNotNull() & F.col("source").isNotNull() & ~expected.eqNullSafe(F.col("target")), F.concat(F.lit("target mismatch: expected "), expected, F.lit(", got "), F.coalesce("target", F.lit("None")))),
    )
    return j.select("case_id", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def first_hits(files: DataFrame, identifiers: list[str], key: str, text: str = "text") -> DataFrame:
    """(key, identifier, line): where a file first has each of a short list of identifiers as a whole word."""
    t = F.col(text)
    place = lambda i: F.regexp_instr(t, F.lit(rf"(?<![A-Za-z0-9]){i}(?![A-Za-z0-9])"))
    line = lambda p: F.length(F.regexp_replace(F.substring(t, F.lit(1), p - 1), r"[^\n]", "")) + 1
    hits = F.array(*[F.when(place(i) > 0, F.struct(F.lit(i).alias("identifier"), line(place(i)).alias("line"))) for i in identifiers])
    return files.select(key, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select(key, "h.*")


def identifier_hits(files: DataFrame, identifiers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, identifier, line): where each file first has each identifier (identifier), in letters of any case, not inside a longer word.

    Underscores do not make a word longer. Words of the files are joined with the first
    word of each identifier, and only the pairs that this leaves are searched; so there may
    be any number of identifiers. Those without a letter or digit are left out.
    """
    first = lambda c: F.lower(F.regexp_extract(c, "[A-Za-z0-9]+", 0))
    wanted = identifiers.select("identifier").distinct().withColumn("_w", first("identifier")).where("_w <> ''")
    words = files.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))).alias("_w"))
    pairs = words.join(wanted, "_w").select(key, "identifier").join(files.select(key, F.col(text).alias("_t")), key)
    place = F.regexp_instr("_t", F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), "identifier", F.lit(r"\E(?![A-Za-z0-9])")))
    found = pairs.withColumn("_at", place).where("_at > 0")
    return found.select(key, "identifier", (F.length(F.regexp_replace(F.expr("substring(_t, 1, _at - 1)"), r"[^\n]", "")) + 1).alias("line"))


def case_profiles(cases: DataFrame, recipes: DataFrame, profiles: DataFrame) -> DataFrame:
    """``cases`` with the columns of the profile that their recipe names; null without a recipe or a profile."""
    return cases.join(recipes.select("case_id", "profile"), "case_id", "left").join(profiles, "profile", "left")


def run_rows(cases: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """One row a case with a struct column for each part (metrics, score, accounting and the like).

    A part without the case is null, and ``failed`` names it; so a case whose run broke off
    keeps its row. Each part has the case at most once.
    """
    out = cases
    for name, part in parts.items():
        out = out.join(part.select(key, F.struct(*[c for c in part.columns if c != key]).alias(name)), key, "left")
    return out.withColumn("failed", F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in parts])))


def state_fields(variables: DataFrame, driver: str, known: dict[str, str]) -> DataFrame:
    """(driver, field, type) of the device state that a program's expressions read: (driver, name) of their variables.

    ``known`` has the type of each member that counts; a member is read as ``->member`` or ``.member``.
    """
    hits = F.array_compact(F.array(*[F.when(F.col("name").rlike(rf"(?:->|\.){f}\b"), F.struct(F.lit(f).alias("field"), F.lit(t).alias("type"))) for f, t in known.items()]))
    return variables.select(driver, F.explode(hits).alias("h")).select(driver, "h.*").distinct()


def instantiated(calls: DataFrame, ops: DataFrame, functions: DataFrame) -> DataFrame:
    """(call columns, pos, kind, address, value, guard): a callee's operations with its parameters replaced by the arguments of each call.

    ``calls`` has (callee, args), ``functions`` (symbol, params: names), ``ops`` (symbol,
    pos, kind, address, value, guard). A call with fewer arguments than parameters leaves
    the rest as they are; names of members are never replaced.
    """
    from tracewell.functions.folds import substituted

    f = functions.select(F.col("symbol").alias("callee"), "params")
    n = F.least(F.size("params"), F.size("args"))
    mapping = F.map_from_arrays(F.slice("params", F.lit(1), n), F.slice("args", F.lit(1), n))
    got = calls.join(f, "callee").withColumn("_m", mapping).join(ops.withColumnRenamed("symbol", "callee"), "callee")
    return got.select(*calls.columns, "pos", "kind", *[substituted(F.col(c), F.col("_m")).alias(c) for c in ("address", "value", "guard")])


def guard_issues(cases: DataFrame, files: DataFrame, inventory: DataFrame, allowed: DataFrame, first_run: str) -> DataFrame:
    """(issue) of a frozen holdout: sources that changed or are gone, identifiers in protected files, specialisations beyond the allowed.

    ``cases`` has (case_id, source_sha256, text, identifiers); ``files``
    (path, text) are the protected ones; ``inventory`` and ``allowed`` have (category,
    value). ``first_run`` has to be one of the cases.
    """
    actual = F.sha2(F.col("text").cast("binary"), 256)
    drift = F.when(F.col("text").isNull(), F.concat(F.lit("missing holdout source of "), F.col("case_id"))).when(actual != F.col("source_sha256"), F.concat(F.lit("source hash drift for "), F.col("case_id")))
    out = cases.select(drift.alias("issue")).where("issue IS NOT NULL")
    hits = identifier_hits(files, cases.select(F.explode("identifiers").alias("identifier")), "path")
    out = out.unionByName(hits.select(F.format_string("holdout specialization %s in %s:%d", "identifier", "path", "line").alias("issue")))
    extra = inventory.join(allowed, ["category", "value"], "left_anti").groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("v"))
    out = out.unionByName(extra.select(F.format_string("new %s specialization(s): %s", "category", "v").alias("issue")))
    known = cases.agg(F.coalesce(F.bool_or(F.col("case_id") == first_run), F.lit(False)).alias("ok"))
    return out.unionByName(known.where("NOT ok").select(F.lit("holdout cases or first_run are invalid").alias("issue")))
