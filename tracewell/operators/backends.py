"""What a backend needs of a device: its bind rows, and the callback calls that exercise its modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The types of a bind, the callback owners a binding may name, and the field that a role fills.
TYPES = {
    "linux": {"MmioBase": "void __iomem *", "LogicalIRQ": "struct irq_data *", "UInt": "u32", "UIntPtr": "unsigned long *"},
    "baremetal": {"MmioBase": "uintptr_t", "LogicalIRQ": "unsigned int", "UInt": "uint32_t", "UIntPtr": "uint32_t *"},
    "harness": {"MmioBase": "uintptr_t", "LogicalIRQ": "unsigned int", "UInt": "uint32_t", "UIntPtr": "uint32_t *"},
}
INCLUDES = ("<linux/io.h>", "<linux/platform_device.h>")
PUBLIC_CALLBACK_OWNERS = (
    "irq_chip", "irq_handler", "gpio_chip", "gpio_irq_chip",
    "platform_driver", "pci_driver", "amba_driver", "i2c_driver",
    "spi_driver", "virtio_config_ops", "virtio_driver", "virtqueue_info",
    "clk_ops", "dev_pm_ops", "file_operations", "input_dev",
    "usb_ep_ops", "usb_gadget_ops", "hc_driver",
    "sdhci_ops", "mmc_host_ops",
)
ROLE_FIELD = {
    "interrupt_ack": "irq_ack", "interrupt_mask": "irq_mask",
    "interrupt_unmask": "irq_unmask", "set_irq_type": "irq_set_type",
    "interrupt_handler": "handle_irq",
}
# Callback tables in the order they are exercised, with the register and the default arguments of each call.
GPIO_TABLES = (
    "gpio_chip.get", "gpio_chip.get_multiple", "gpio_chip.set", "gpio_chip.set_multiple",
    "gpio_chip.direction_input", "gpio_chip.direction_output", "gpio_chip.get_direction",
)
ARGUMENTS = {"offset": 1, "value": 1, "mask": 3, "bits": 1}
SDHCI_CALLS = (
    ("sdhci_ops.read_l", "SDHCI_CAPABILITIES", 0x40, None),
    ("sdhci_ops.read_l", "SDHCI_PRESENT_STATE", 0x24, None),
    ("sdhci_ops.read_w", "SDHCI_HOST_VERSION", 0xFE, None),
    ("sdhci_ops.read_w", "SDHCI_SLOT_INT_STATUS", 0xFC, None),
    ("sdhci_ops.read_w", "SDHCI_CLOCK_CONTROL", 0x2C, None),
    ("sdhci_ops.read_b", "SDHCI_POWER_CONTROL", 0x29, None),
    ("sdhci_ops.write_l", "SDHCI_BUFFER", 0x20, 0x11223344),
    ("sdhci_ops.write_w", "SDHCI_TRANSFER_MODE", 0x0C, 0x1234),
    ("sdhci_ops.write_w", "SDHCI_COMMAND", 0x0E, 0x5678),
    ("sdhci_ops.write_w", "SDHCI_CLOCK_CONTROL", 0x2C, 0xABCD),
    ("sdhci_ops.write_b", "SDHCI_POWER_CONTROL", 0x29, 0xA5),
)
STATE_ROLES = {"probe": 0, "interrupt_handler": 1, "write_config": 2, "suspend": 3, "resume": 4, "remove": 5}


def primitives(backend: str) -> list[tuple[str, str, str]]:
    """(primitive, width, name of the backend's function), in the order of a bind."""
    out = []
    for width, bits, letter in (("B4", 32, "l"), ("B2", 16, "w"), ("B1", 8, "b")):
        for kind in ("Read", "Write"):
            plain = f"{kind.lower()}{letter}" if backend == "linux" else f"{'mmio' if backend == 'baremetal' else backend}_{kind.lower()}{bits}"
            out.append((f"Mmio{kind}", width, plain))
    for width, bits, letter in (("B4", 32, "l"), ("B2", 16, "w"), ("B1", 8, "b")):
        out.append(("MmioWriteW1C", width, f"write{letter}" if backend == "linux" else f"{'mmio' if backend == 'baremetal' else backend}_write_w1c{bits}"))
    for width, bits in (("B2", 16), ("B4", 32)):
        for kind in ("Read", "Write"):
            name = f"io{kind.lower()}{bits}be" if backend == "linux" else f"{'mmio' if backend == 'baremetal' else backend}_{kind.lower()}{bits}be"
            out.append((f"Mmio{kind}BE", width, name))
    return out


def _fixed(backend: str) -> list[tuple[str, int, str, str]]:
    """(section, ord, name, value) of the rows that every device of a backend has."""
    rows = [("include", k, x, "") for k, x in enumerate(INCLUDES)] if backend == "linux" else []
    rows += [("type", k, n, v) for k, (n, v) in enumerate(TYPES[backend].items(), 1)]
    return rows + [("primitive", k, f"{p}.{w}", v) for k, (p, w, v) in enumerate(primitives(backend))]


def default_binds(devices: DataFrame, functions: DataFrame, backends: tuple[str, ...] = ("linux", "baremetal", "harness")) -> DataFrame:
    """(device, backend, section, ord, name, value): the default bind of each device for each backend.

    ``devices`` has (device, cls, base): ``base`` is the mapping expression of the first
    function's first base, null without one. ``functions`` has (device, ord, name, role,
    is_entry, callback_table). Sections are include, type, primitive, state, and callback
    (linux) or export (baremetal), numbered by the functions' ``ord``. An entry whose
    owner is public and whose role is known becomes a callback: of its table's field, or
    of the field its role fills; probe and remove go to the platform driver.
    """
    spark: SparkSession = devices.sparkSession
    fixed = spark.createDataFrame([(b, *r) for b in backends for r in _fixed(b)], "backend string, section string, ord int, name string, value string")
    names = spark.createDataFrame([(b,) for b in backends], "backend string")
    private = F.concat(F.lit("struct "), F.regexp_replace("device", "[^A-Za-z0-9_]", "_"), F.when(F.col("cls") == "gpio_controller", "").otherwise("_priv"))
    base = F.when(F.col("backend") == "linux", F.coalesce("base", F.lit("g->base"))).otherwise("dev->base")
    row = lambda s, o, n, v: F.struct(F.lit(s).alias("section"), F.lit(o).alias("ord"), F.lit(n).alias("name"), v.alias("value"))
    of = devices.select("device", "cls", "base")
    # the tables of backends are fixed lists of at most 60 rows, so each device is multiplied by a constant
    own = of.crossJoin(F.broadcast(names)).select("device", "backend", F.inline(F.array(row("type", 0, "DeviceState", private), row("state", 0, "dev.base", base))))
    shared = of.select("device").crossJoin(F.broadcast(fixed)).select("device", "backend", "section", "ord", "name", "value")
    table, role = F.coalesce("callback_table", F.lit("")), F.col("role")
    public = F.coalesce(F.col("is_entry"), F.lit(False)) & (table != "") & ~F.coalesce(role.isin("unknown", "helper"), F.lit(False)) & F.substring_index(table, ".", 1).isin(*PUBLIC_CALLBACK_OWNERS)
    field = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_FIELD.items() for x in kv]), role)
    callback = F.when(public, F.when(table.contains("."), table).otherwise(F.concat(table, F.lit("."), field))).when(role.isin("probe", "remove"), F.concat(F.lit("platform_driver."), role))
    parts = {
        "linux": functions.select("device", F.lit("linux").alias("backend"), F.lit("callback").alias("section"), "ord", callback.alias("name"), F.col("name").alias("value")),
        "baremetal": functions.select("device", F.lit("baremetal").alias("backend"), F.lit("export").alias("section"), "ord", role.alias("name"), F.concat_ws("_", "device", "role").alias("value")),
    }
    out = own.unionByName(shared)
    for backend, part in parts.items():
        if backend in backends:
            out = out.unionByName(part.where(F.col("name").isNotNull()))
    return out


def _argument_map(values: Column) -> Column:
    """Each parameter but the device's state with its value, 1 if none is set."""
    wanted = F.filter(F.coalesce("params", F.array().cast("array<struct<name:string,type:string>>")), lambda p: ~p["type"].eqNullSafe("DeviceState"))
    return F.map_from_entries(F.transform(wanted, lambda p: F.struct(p["name"], F.coalesce(F.element_at(values, p["name"]), F.lit(1).cast("bigint")))))


def _latest(functions: DataFrame, tables: tuple[str, ...]) -> DataFrame:
    """The last portable function of each of the tables, one row a (device, table)."""
    of = functions.where(F.col("portable") & F.col("callback_table").isin(*tables))
    return of.groupBy("device", F.col("callback_table").alias("table")).agg(F.max_by(F.struct("module", "params"), "ord").alias("_f")).select("device", "table", "_f.*")


def callback_plans(devices: DataFrame, functions: DataFrame, registers: DataFrame) -> DataFrame:
    """(device, kind, table, pos, module, args): the calls that exercise a device's callbacks, ordered by ``pos`` within a kind.

    ``devices`` has (device, cls, state_only), ``functions`` (device, ord, module, role,
    callback_table, params, portable, ops, returns), ``registers`` (device, name, offset).
    Of several portable functions of a table the last holds. A setter is called with 1 and
    then with 0; controllers of class sdhci get fixed register values at their own
    offsets, where they have them; state-only virtio devices run their modules by role.
    """
    spark: SparkSession = devices.sparkSession
    number = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v).cast("bigint") if isinstance(v, int) else v)])
    g = _latest(functions, GPIO_TABLES)
    order = F.array_position(F.array(*map(F.lit, GPIO_TABLES)), F.col("table"))
    g = g.select("*", F.explode(F.when(F.col("table") == "gpio_chip.set", F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1))).cast("array<bigint>")).alias("_v"))
    gpio = g.select("device", F.lit("gpio").alias("kind"), "table", (order * 2 - F.col("_v")).cast("int").alias("pos"), "module", _argument_map(number({**ARGUMENTS, "value": F.col("_v")})).alias("args"))

    calls = spark.createDataFrame([(t, k, r, o, v) for k, (t, r, o, v) in enumerate(SDHCI_CALLS)], "table string, pos int, register string, at bigint, value bigint")
    of = _latest(functions, tuple(dict.fromkeys(t for t, *_ in SDHCI_CALLS))).join(devices.where(F.col("cls") == "sdhci").select("device"), "device")
    at = registers.groupBy("device", F.col("name").alias("register")).agg(F.max("offset").alias("offset"))
    s = of.join(F.broadcast(calls), "table").join(at, ["device", "register"], "left")
    value = F.coalesce("value", F.lit(1).cast("bigint"))
    sdhci = s.select("device", F.lit("sdhci").alias("kind"), "table", "pos", "module", _argument_map(number({"reg": F.coalesce("offset", "at"), "val": value, "value": value})).alias("args"))

    v = functions.join(devices.where(F.col("state_only") & (F.col("cls") == "virtio_mmio")).select("device"), "device").where(F.col("ops") > 0)
    rank = F.coalesce(F.element_at(number(STATE_ROLES), F.col("role")), F.lit(2).cast("bigint"))
    per = v.groupBy("device").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "module", F.coalesce("callback_table", "role").alias("table"), "params"))).alias("_l"))
    virtio = per.select("device", F.posexplode("_l").alias("pos", "_f")).select("device", "pos", "_f.*").select("device", F.lit("virtio").alias("kind"), "table", "pos", "module", _argument_map(number(ARGUMENTS)).alias("args"))
    return gpio.unionByName(sdhci).unionByName(virtio)


def drain_plans(functions: DataFrame, loops: DataFrame) -> DataFrame:
    """(device, module, loop) of the modules of known functions with exactly one proved drain; ``loops`` has (device, module, proof_kind, loop)."""
    one = loops.where(F.col("proof_kind") == "masked_w1c_drain").groupBy("device", "module").agg(F.count(F.lit(1)).alias("_n"), F.first("loop").alias("loop")).where("_n = 1")
    return one.join(functions.select("device", "module").distinct(), ["device", "module"], "left_semi").drop("_n")


def holdout_contexts(cases: DataFrame, recipes: DataFrame, profiles: DataFrame, commands: DataFrame) -> DataFrame:
    """(case_id, source, profile, profile_kind, arch, defconfig, target, directory, command, raw_command_sha256, problem) of every frozen case.

    ``recipes`` has (case_id, profile, target), ``profiles`` (profile, kind, arch, build_dir,
    defconfig), ``commands`` (directory, source, command): the saved build commands. A case
    is exact if ``problem`` is null; directory, source and command of the exact ones make
    the merged compile database.
    """
    p = profiles.select("profile", F.col("kind").alias("profile_kind"), "arch", F.col("build_dir").alias("directory"), "defconfig")
    j = cases.select("case_id", "source").join(recipes.select("case_id", "profile", "target"), "case_id", "left").join(p, "profile", "left")
    j = j.join(commands.groupBy("directory", "source").agg(F.min("command").alias("command")), ["directory", "source"], "left")
    problem = (
        F.when(F.col("profile").isNull(), "case without a recipe").when(F.col("profile_kind").isNull(), F.concat(F.lit("missing profile "), "profile"))
        .when(F.coalesce("command", F.lit("")) == "", F.concat("case_id", F.lit(" produced no saved build command")))
    )
    return j.select("case_id", "source", "profile", "profile_kind", "arch", "defconfig", "target", "directory", "command", F.sha2("command", 256).alias("raw_command_sha256"), problem.alias("problem"))
