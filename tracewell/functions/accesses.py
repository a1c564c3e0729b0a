"""Register accesses by the name of what is called: kind, domain, width, and what each argument is.

All are column expressions over a callee's name and its argument texts (array<string>).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.expressions import let

#: The names of the calls, by what they do.
READS = (
    "readb", "readw", "readl", "readq", "ioread8", "ioread16", "ioread32", "ioread64", "__raw_readb", "__raw_readw", "__raw_readl", "__raw_readq",
    "__readb", "__readw", "__readl", "__readq", "inb", "inw", "inl", "readb_relaxed", "readw_relaxed", "readl_relaxed", "readq_relaxed",
)
WRITES = (
    "writeb", "writew", "writel", "writeq", "iowrite8", "iowrite16", "iowrite32", "iowrite64", "__raw_writeb", "__raw_writew", "__raw_writel", "__raw_writeq",
    "__writeb", "__writew", "__writel", "__writeq", "outb", "outw", "outl", "writeb_relaxed", "writew_relaxed", "writel_relaxed", "writeq_relaxed",
)
#: Accessors of (state, offset), or (state, value, offset), and the field of the state that is the base.
FIELD_READS = {"regs": ("dwc2_readl",), "ioaddr": ("sdhci_readb", "sdhci_readw", "sdhci_readl", "sdhci_be32bs_readb", "sdhci_be32bs_readw", "sdhci_be32bs_readl")}
FIELD_WRITES = {"regs": ("dwc2_writel",), "ioaddr": ("sdhci_writeb", "sdhci_writew", "sdhci_writel", "sdhci_be32bs_writeb", "sdhci_be32bs_writew", "sdhci_be32bs_writel")}
#: Accessors whose second argument is the address (and the third the value).
DIRECT_READS = ("gpio_generic_read_reg",)
DIRECT_WRITES = ("gpio_generic_write_reg",)
CONFIG_READS = ("virtio_cread_le", "virtio_cread_bytes")
CONFIG_WRITES = ("virtio_cwrite_le",)
#: Queue calls and the offset that stands for them; of the writes also the argument with the value.
QUEUE_READS = {"virtqueue_get_buf": 4, "virtqueue_detach_unused_buf": 4, "virtqueue_get_vring_size": 12}
QUEUE_WRITES = {"virtqueue_add_inbuf_cache_clean": (3, 0), "virtqueue_add_outbuf": (3, 0), "virtqueue_kick": (None, 8)}
MAP_READS = ("regmap_read",)
MAP_WRITES = ("regmap_write",)
MAP_UPDATES = ("regmap_update_bits",)
SUMMARIES = ("gpio_generic_chip_init",)
UNSUPPORTED = (
    "regmap_bulk_read", "regmap_bulk_write", "regmap_raw_read", "regmap_raw_write", "memcpy_fromio", "memcpy_toio", "memset_io",
    "ioread32_rep", "iowrite32_rep", "pci_read_config_dword", "pci_write_config_dword",
)
DELAYS = ("mdelay", "udelay", "ndelay", "msleep", "ssleep")
MAPPINGS = (
    "ioremap", "ioremap_wc", "ioremap_uc", "ioremap_cache", "ioremap_nocache", "devm_ioremap", "devm_ioremap_resource", "devm_ioremap_resource_byname",
    "devm_platform_ioremap_resource", "devm_platform_ioremap_resource_byname", "of_iomap", "pci_iomap", "pcim_iomap", "devm_pci_iomap", "pci_ioremap_bar", "pci_ioremap_wc_bar",
)
#: Calls that belong to the framework and never touch a register.
FRAMEWORK = (
    "kmalloc", "kzalloc", "kcalloc", "kfree", "krealloc", "devm_kmalloc", "devm_kzalloc", "devm_kfree", "dma_alloc_coherent", "dma_free_coherent", "dma_alloc_attrs",
    "dma_map_single", "dma_unmap_single", "dma_map_sg", "dma_unmap_sg", "spin_lock", "spin_unlock", "spin_lock_irqsave", "spin_unlock_irqrestore", "spin_lock_irq", "spin_unlock_irq",
    "mutex_lock", "mutex_unlock", "mutex_trylock", "down_read", "up_read", "down_write", "up_write", "request_irq", "free_irq", "request_threaded_irq", "enable_irq", "disable_irq",
    "disable_irq_nosync", "tasklet_schedule", "tasklet_init", "platform_driver_register", "platform_driver_unregister", "register_chrdev", "unregister_chrdev", "register_netdev",
    "unregister_netdev", "alloc_chrdev_region", "unregister_chrdev_region", "platform_get_resource", "platform_get_irq", "devm_request_irq", "devm_request_mem_region",
    "of_property_read_u32", "of_property_read_string", "device_property_read_u32", "device_property_read_string", "pr_info", "pr_err", "pr_warn", "pr_debug", "pr_notice",
    "dev_info", "dev_err", "dev_warn", "dev_dbg", "printk", "dump_stack", "module_init", "module_exit", "kthread_create", "kthread_run", "kthread_stop", "wait_for_completion",
    "complete", "schedule", "wait_event", "clk_prepare", "clk_enable", "clk_unprepare", "clk_disable", "clk_prepare_enable", "clk_disable_unprepare", "pm_runtime_get_sync", "pm_runtime_put_sync",
)

_ACCESSORS = [*FIELD_READS["ioaddr"], *FIELD_WRITES["ioaddr"]]
ALL_READS = (*READS, *FIELD_READS["regs"], *FIELD_READS["ioaddr"], *DIRECT_READS, *CONFIG_READS, *QUEUE_READS, *MAP_READS)
ALL_WRITES = (*WRITES, *FIELD_WRITES["regs"], *FIELD_WRITES["ioaddr"], *DIRECT_WRITES, *CONFIG_WRITES, *QUEUE_WRITES, *MAP_WRITES)


def effective_name(name: Column, call_text: Column) -> Column:
    """The accessor that the source names where a macro's expansion hides it."""
    text = F.ltrim(F.coalesce(call_text, F.lit("")))
    return F.when((name == "set") & text.startswith("virtio_cwrite_le("), "virtio_cwrite_le").when((name == "__virtio_cread_many") & text.startswith("virtio_cread_le("), "virtio_cread_le").otherwise(name)


def kind(name: Column) -> Column:
    """read, write, rmw, unsupported or summary, tried in this order; null for any other call."""
    return (
        F.when(name.isin(*ALL_READS), "read").when(name.isin(*ALL_WRITES), "write").when(name.isin(*MAP_UPDATES), "rmw")
        .when(name.isin(*UNSUPPORTED), "unsupported").when(name.isin(*SUMMARIES), "summary")
    )


def initial_status(name: Column, blacklist: tuple[str, ...] = ()) -> Column:
    """What an access counts as before any operation is known: filtered, unsupported or pending; null for no access."""
    k = kind(name)
    return F.when(k.isNotNull(), F.when(name.isin(*blacklist) if blacklist else F.lit(False), "filtered").when(k == "unsupported", "unsupported").otherwise("pending"))


def domain(name: Column) -> Column:
    """regmap, virtio_config, virtqueue or mmio."""
    return F.when(name.isin(*MAP_READS, *MAP_WRITES, *MAP_UPDATES), "regmap").when(name.isin(*CONFIG_READS, *CONFIG_WRITES), "virtio_config").when(name.isin(*QUEUE_READS, *QUEUE_WRITES), "virtqueue").otherwise("mmio")


def summary_kind(name: Column) -> Column:
    """Which subsystem's contract describes the call; null for plain accessors."""
    return (
        F.when(name.isin(*_ACCESSORS), "sdhci_accessor").when(name.isin(*DIRECT_READS, *DIRECT_WRITES), "gpio_generic_accessor").when(name.isin(*CONFIG_READS, *CONFIG_WRITES), "virtio_config")
        .when(name.isin(*QUEUE_READS, *QUEUE_WRITES), "virtqueue").when(name.isin(*SUMMARIES), "gpio_generic_chip")
    )


def is_framework(name: Column) -> Column:
    """Whether a call belongs to the framework; false for null."""
    return F.coalesce(name.isin(*FRAMEWORK), F.lit(False))


def width(name: Column, type_size: Column | None = None) -> Column:
    """Bytes of an access by the end of its name, or by the size of the type involved where the call leaves it open."""
    by_name = F.when(name.rlike("(64|q)$"), 8).when(name.rlike("(32|l)$"), 4).when(name.rlike("(16|w)$"), 2).when(name.rlike("(8|b)$"), 1).otherwise(4)
    out = F.when(name == "virtio_cread_bytes", 1)
    if type_size is not None:
        out = out.when(name.isin("virtio_cread_le", "virtio_cwrite_le", "gpio_generic_read_reg") & type_size.isin(1, 2, 4, 8), type_size.cast("int"))
    return out.otherwise(by_name)


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _pointee(arg: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(arg), "^[&*]+", ""))


def _field(name: Column, layouts: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*[F.when(name.isin(*names), F.lit(f)) for f, names in layouts.items()])


def read_address(name: Column, args: Column) -> Column:
    """The address text that a read's arguments give; empty if arguments are missing."""
    a, n = lambda i: F.get(args, i), F.size(args)
    field = _field(name, FIELD_READS)
    queue = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in QUEUE_READS.items()])
    none = F.lit("")
    return (
        F.when((name == "virtio_cread_le") & (n >= 3), _cat(a(0), " + offsetof(", a(1), ", ", a(2), ")"))
        .when((name == "virtio_cread_bytes") & (n >= 2), _cat(a(0), " + ", a(1)))
        .when(queue.isNotNull() & (n >= 1), _cat(a(0), " + ", queue.cast("string")))
        .when(name.isin(*DIRECT_READS), F.coalesce(a(1), none))
        .when(name.isin(*MAP_READS), F.when(n >= 3, _cat(a(0), " + ", a(1))).otherwise(none))
        .when(field.isNotNull(), F.when(n >= 2, _cat(a(0), "->", field, " + ", a(1))).otherwise(none))
        .otherwise(F.coalesce(a(0), none))
    )


def write_parts(name: Column, args: Column) -> Column:
    """struct(value, address) of a write's arguments; empty texts if arguments are missing."""
    a, n = lambda i: F.get(args, i), F.size(args)
    field = _field(name, FIELD_WRITES)
    queue = F.coalesce(*[F.when(name == k, F.lit(off)) for k, (_, off) in QUEUE_WRITES.items()])
    pair = lambda value, address: F.struct(value.alias("value"), address.alias("address"))
    none = pair(F.lit(""), F.lit(""))
    queued = F.coalesce(*[F.when(name == k, F.lit("1") if v is None else F.coalesce(a(v), F.lit(""))) for k, (v, _) in QUEUE_WRITES.items()])
    return (
        F.when((name == "virtio_cwrite_le") & (n >= 4), pair(_pointee(a(3)), _cat(a(0), " + offsetof(", a(1), ", ", a(2), ")")))
        .when(queue.isNotNull() & (n >= 1), pair(queued, _cat(a(0), " + ", queue.cast("string"))))
        .when(name.isin(*DIRECT_WRITES), F.when(n >= 3, pair(a(2), a(1))).otherwise(none))
        .when(name.isin(*MAP_WRITES), F.when(n >= 3, pair(a(2), _cat(a(0), " + ", a(1)))).otherwise(none))
        .when(field.isNotNull(), F.when(n >= 3, pair(a(1), _cat(a(0), "->", field, " + ", a(2)))).otherwise(none))
        .otherwise(pair(F.coalesce(a(0), F.lit("")), F.coalesce(F.when(n >= 2, a(1)), F.lit(""))))
    )


def result_variable(name: Column, args: Column, assigned: Column) -> Column:
    """What a read's result goes to: an output argument, or what the call is assigned to."""
    a, n = lambda i: F.get(args, i), F.size(args)
    return (
        F.when((name == "virtio_cread_le") & (n >= 4), _pointee(a(3))).when((name == "virtio_cread_bytes") & (n >= 3), _pointee(a(2)))
        .when(name.isin(*MAP_READS) & (n >= 3), _pointee(a(2))).otherwise(assigned)
    )


def update_parts(name: Column, args: Column) -> Column:
    """struct(address, mask, value) of a read-modify-write call; null for any other, or if arguments are missing."""
    a = lambda i: F.get(args, i)
    return F.when(name.isin(*MAP_UPDATES) & (F.size(args) >= 4), F.struct(_cat(a(0), " + ", a(1)).alias("address"), a(2).alias("mask"), a(3).alias("value")))


def _nested(opening: str, closing: str, levels: int = 4) -> str:
    """A pattern of a bracketed text with up to ``levels`` of brackets in it, 64 side by side in each."""
    plain = f"[^{opening}{closing}]*+"
    out = f"[{opening}]{plain}[{closing}]"
    for _ in range(levels - 1):
        out = f"[{opening}]{plain}(?:{out}{plain}){{0,64}}+[{closing}]"
    return out


#: Texts of usual nesting; what they do not fit is folded character by character.
_ROUND = rf"^([^()]*+{_nested('(', ')')})"
_PART = rf"\G([^,()\[\]{{}}]*+(?:{_nested(r'(\[{', r')\]}')}[^,()\[\]{{}}]*+){{0,64}}+),"


def balanced(text: Column) -> Column:
    """A text from its start to the bracket that closes its first round one; null if none does."""
    def folded(t: Column) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(t, _ROUND, 1), F.lit("")), _balanced(t))

    return let(text, folded)


def _balanced(text: Column) -> Column:
    """As ``balanced``, of any nesting."""
    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), ((c == ")") & (depth == 0)).alias("done"), (s["n"] + 1).alias("n")))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit(0).alias("n"))
    return let(F.aggregate(F.split(text, ""), start, step), lambda s: F.when(s["done"], F.substring(text, F.lit(1), s["n"])))


def split_arguments(body: Column) -> Column:
    """A text's parts between the commas outside brackets, trimmed; one empty part for an empty text."""
    def split(b: Column) -> Column:
        found = F.regexp_extract_all(F.concat(b, F.lit(",")), F.lit(_PART), F.lit(1))
        size = lambda parts: F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p) + 1)
        return let(found, lambda parts: F.when(size(parts) == F.length(b) + 1, parts).otherwise(_split_arguments(b)))

    return F.transform(let(body, split), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))


def _split_arguments(body: Column) -> Column:
    """As ``split_arguments``, of any nesting and with brackets that do not close, not trimmed."""
    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}") & (s["depth"] > 0), -1).otherwise(0)
        cut = (c == ",") & (depth == 0)
        return F.struct(depth.alias("depth"), F.when(cut, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]).alias("out"), F.when(cut, F.lit("")).otherwise(F.concat(s["now"], c)).alias("now"))

    start = F.struct(F.lit(0).alias("depth"), F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("now"))
    # split("", "") gives one empty string, which adds nothing
    return F.aggregate(F.split(body, ""), start, step, lambda s: F.concat(s["out"], F.array(s["now"])))


def call_arguments(text: Column) -> Column:
    """The arguments of a call's text, from its first opening bracket to its last closing one; empty without both."""
    body = F.regexp_extract(text, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?s)\(.*\)"), split_arguments(body)).otherwise(F.expr("cast(array() as array<string>)"))


def recovered_call(name: Column, args: Column, line: Column) -> Column:
    """struct(name, args) of a call whose expansion lost its arguments, from the text of its line.

    The longest accessor of the same kind and width that the line calls is taken. A call
    with an argument, or a line without such an accessor, leaves name and args as they are.
    """
    known = F.exists(args, lambda a: F.trim(a) != "")
    found = F.regexp_extract_all(line, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    same = F.filter(found, lambda c: c.isin(*READS, *WRITES) & (kind(c) == kind(name)) & (width(c) == width(name)))
    longest = F.aggregate(same, F.lit(None).cast("string"), lambda s, c: F.when(s.isNull() | (F.length(c) > F.length(s)), c).otherwise(s))

    def read(c: Column) -> Column:
        return let(balanced(F.regexp_substr(line, F.concat(F.lit(r"(?s)\b"), c, F.lit(r"\s*\(.*")))), lambda t: F.when(t.isNotNull(), F.struct(c.alias("name"), call_arguments(t).alias("args"))))

    return F.coalesce(F.when(~F.coalesce(known, F.lit(False)), let(longest, read)), F.struct(name.alias("name"), args.alias("args")))
