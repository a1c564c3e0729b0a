"""Roles of callbacks and functions, what a role means, and abstract types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.rules import ROLE_HINTS, hinted

#: Fixed values: (role, context) of the fields of public callback tables.
FIELD_ROLES = {
    ("interrupt_ack", "irq"): "irq_ack irq_eoi",
    ("interrupt_mask", "irq"): "irq_mask irq_mask_ack irq_disable",
    ("interrupt_unmask", "irq"): "irq_unmask irq_enable",
    ("set_irq_type", "irq"): "irq_set_type irq_set_affinity irq_set_wake",
    ("interrupt_handler", "irq"): "handle_irq irq_handler parent_handler callback irq",
    ("init", "boot"): "init_hw init",
    ("probe", "boot"): "probe",
    ("remove", "thread"): "remove shutdown del_vqs unprepare disable free_request dequeue udc_stop stop urb_dequeue endpoint_disable clear_tt_buffer_complete unmap_urb_for_dma free_dev free exit",
    ("suspend", "sleepable"): "suspend freeze poweroff bus_suspend",
    ("resume", "sleepable"): "resume thaw restore bus_resume",
    ("read_config", "thread"): "get get_multiple get_shm_region read_l read_w read_b recalc_rate determine_rate round_rate match_ep get_direction read",
    ("write_config", "thread"): (
        "set set_multiple event write_l write_w write_b set_rate set_halt set_wedge fifo_flush set_remote_wakeup set_selfpowered vbus_session vbus_draw pullup udc_set_speed hub_control "
        "direction_input direction_output set_config write"
    ),
    ("get_status", "thread"): "generation get_status is_enabled fifo_status get_frame get_frame_number hub_status_data",
    ("set_status", "thread"): "set_status",
    ("reset", "thread"): "reset endpoint_reset reset_device",
    ("setup_queue", "thread"): "find_vqs queue urb_enqueue map_urb_for_dma",
    ("notify", "thread"): "notify_vq notify",
    ("init", "thread"): "prepare enable alloc_request udc_start start request open",
    ("resume", "thread"): "wakeup func_wakeup",
}
#: The callback tables whose fields say a role.
PUBLIC_TABLES = (
    "irq_chip", "irq_handler", "gpio_chip", "gpio_irq_chip", "platform_driver", "pci_driver", "amba_driver", "i2c_driver", "spi_driver", "virtio_config_ops", "virtio_driver",
    "virtqueue_info", "clk_ops", "dev_pm_ops", "file_operations", "input_dev", "usb_ep_ops", "usb_gadget_ops", "hc_driver", "sdhci_ops", "mmc_host_ops",
)
#: Role, what it does, what holds afterwards, what it needs.
MEANINGS = (
    ("interrupt_ack", "clears_interrupt(line)", "interrupt_pending[line] == false", None),
    ("interrupt_mask", "masks_interrupt(line)", "interrupt_enabled[line] == false", None),
    ("interrupt_unmask", "unmasks_interrupt(line)", "interrupt_enabled[line] == true", None),
    ("set_irq_type", "sets_irq_type(line)", "irq_type[line] == configured", None),
    ("interrupt_handler", "handles_interrupt()", "interrupt_serviced", None),
    ("reset", "resets_device()", "device_state == RESET", None),
    ("init", "initializes_device()", "device_state == READY", None),
    ("probe", "initializes_device()", "device_state == READY", "resources_available"),
    ("remove", "releases_device()", "device_state == OFF", None),
    ("suspend", "suspends_device()", "device_state == SUSPENDED", None),
    ("resume", "resumes_device()", "device_state == READY", None),
    ("setup_queue", "configures_queue(queue)", "queue_ready[queue] == true", None),
    ("notify", "notifies_queue(queue)", "queue_notified[queue]", None),
    ("get_status", "reads_status()", None, None),
    ("set_status", "writes_status()", None, None),
    ("read_config", "reads_config(offset)", None, None),
    ("write_config", "writes_config(offset)", None, None),
)
#: Prefixes of constants that say nothing about a device.
NOISE_PREFIXES = (
    "CONFIG_", "KASAN_", "TASK_", "pt_regs_", "CPUINFO_", "BUG_", "TAINT_", "BITS_PER_", "PAGE_", "VM_", "SLAB_", "KMALLOC_", "NR_", "MAX_", "MIN_",
    "ULONG", "LONG", "UINT", "INT", "CHAR", "SIZE_", "ALIGNOF", "offsetof", "container_of", "READ", "WRITE", "unix", "linux",
)
#: The last members of an lvalue that are known to hold a mapped base.
BASE_MEMBERS = ("base", "regs", "reg", "ioaddr", "mmio", "mmio_base", "reg_base", "gpio_pub_base", "pll_base")


def field_role(table: Column, field: Column) -> Column:
    """struct(role, context, public) of a callback bound to a table's field; unknown unless the table is public."""
    public = F.coalesce(table.isin(*PUBLIC_TABLES), F.lit(False))
    of = lambda r, c: F.struct(F.lit(r).alias("role"), F.lit(c).alias("context"))
    known = F.coalesce(*[F.when(public & field.isin(*fields.split()), of(*rc)) for rc, fields in FIELD_ROLES.items()], of("unknown", "thread"))
    return F.struct(known["role"].alias("role"), known["context"].alias("context"), public.alias("public"))


def meaning(role: Column) -> Column:
    """struct(effect, ensure, require) of a role; null for roles without."""
    text = lambda x: F.lit(x).cast("string")
    return F.coalesce(*[F.when(role == r, F.struct(text(a).alias("effect"), text(b).alias("ensure"), text(c).alias("require"))) for r, a, b, c in MEANINGS])


def context_of(role: Column) -> Column:
    """irq for interrupt roles and the setting of their type, else thread."""
    return F.when(role.startswith("interrupt") | (role == "set_irq_type"), "irq").otherwise("thread")


def function_role(name: Column, bound_role: Column, bound_context: Column, is_entry: Column) -> Column:
    """struct(role, context) of a function: of its binding; of its name if there is none or it is unknown; else helper, or unknown for an entry."""
    hint = hinted(name, ROLE_HINTS)
    own = F.coalesce(hint, F.when(is_entry, "unknown").otherwise("helper"))
    of = lambda r, c: F.struct(r.alias("role"), c.alias("context"))
    return (
        F.when(bound_role.isNull(), of(own, context_of(own))).when((bound_role == "unknown") & hint.isNotNull(), of(hint, context_of(hint))).otherwise(of(bound_role, bound_context))
    )


def parameter_type(ctype: Column) -> Column:
    """The abstract type of a parameter by its C type; rules in order, UInt for what none fits."""
    c = F.trim(F.coalesce(ctype, F.lit("")))
    low, star = F.lower(c), c.contains("*")
    return (
        F.when(low.contains("irq_data") | (low.contains("irq") & star), "LogicalIRQ").when(low.contains("platform_device") | (low.contains("device") & star) | low.contains("virtio_device") | star, "DeviceState")
        .when(low.rlike("u8|u16|u32|u64|int|unsigned|long|size_t|bool|_t"), "UInt").when(c.isin("void", ""), "Void").otherwise("UInt")
    )


def return_type(ctype: Column) -> Column:
    """Void for none or void, else UInt."""
    return F.when(F.lower(F.trim(F.coalesce(ctype, F.lit("")))).isin("", "void"), "Void").otherwise("UInt")


def mapped_lvalue(name: Column, ctype: Column) -> Column:
    """struct(accepted, reason): whether an lvalue that may alias a mapping is taken for one, by four rules in order."""
    t = F.coalesce(ctype, F.lit(""))
    final = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)(?:^|->|\.)((?:(?!->|\.).)*)$", 1))
    plain = F.trim(F.regexp_replace(F.replace(t, F.lit("const"), F.lit("")), r"\s+", " "))
    of = lambda ok, why: F.struct(F.lit(ok).alias("accepted"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    return (
        F.when(~t.contains("*"), of(False, "candidate is not a pointer lvalue")).when(t.contains("__iomem"), of(True, "typed __iomem pointer")).when(final.isin(*BASE_MEMBERS), of(True, "recognized MMIO base field"))
        .when(plain.isin("void *", "volatile void *"), of(True, "void pointer with SVF mapping provenance")).otherwise(of(False, F.concat(F.lit("aggregate/non-MMIO pointer type: "), F.when(t == "", "?").otherwise(t))))
    )


#: Parameter names that by custom hold a mapped base.
BASE_PARAMETERS = ("base", "regs", "reg_base", "mmio", "mmio_base", "ioaddr", "io_base")


def has_provenance(address: Column, params: Column) -> Column:
    """Whether an address is known to be a mapped one, from the (name, ctype) array of the function's parameters.

    True if it reads a parameter of an ``__iomem`` type or a customary name, or a base
    member of a parameter, or no parameter at all.
    """
    text = F.coalesce(address, F.lit(""))
    compact = F.regexp_replace(text, r"\s+", "")
    named = F.filter(params, lambda p: F.coalesce(p["name"], F.lit("")) != "")
    reads = lambda p: F.call_function("rlike", text, F.concat(F.lit("(?<![A-Za-z0-9_])"), p["name"], F.lit("(?![A-Za-z0-9_])")))
    member = lambda p: F.call_function("rlike", compact, F.concat(F.lit(r"\b"), p["name"], F.lit(rf"(?:->|\.).*(?:{'|'.join(BASE_PARAMETERS)})\b")))
    typed = lambda p: p["ctype"].contains("__iomem") | F.lower(p["name"]).isin(*BASE_PARAMETERS)
    return F.exists(named, lambda p: reads(p) & (F.coalesce(typed(p), F.lit(False)) | member(p))) | ~F.exists(named, reads)
