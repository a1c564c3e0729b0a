"""Source models of devices: the register traces that the original code would give, to hold programs against."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.batches import batched
from tracewell.operators.interpreter import seeded

ACCESS = "struct<kind:string,offset:bigint,value:bigint>"
CALLS = f"struct<data:bigint,direction:bigint,calls:array<struct<table:string,trace:array<{ACCESS}>,result:bigint,bits:bigint,data:bigint,direction:bigint>>,error:string>"


# ---- gpio banks -------------------------------------------------------------------

class Bank:
    """A bank of lines behind memory-mapped registers, with the two shadow words its driver keeps."""

    def __init__(self, offsets: dict[str, int], width: int, flags: set[str], size: int):
        self.at, self.width, self.flags = offsets, width, flags
        self.order: Any = "big" if "big_endian" in flags else "little"
        self.memory, self.ones, self.trace = seeded(size), (1 << 8 * width) - 1, []
        self.pair = "set" in offsets and "clr" in offsets
        self.output = "set" if "set" in offsets else "dat"
        shadowed = "set" if "set" in offsets and not self.pair and "unreadable_set" not in flags else "dat"
        self.data, self.direction = self.peek(shadowed), 0
        if "unreadable_dir" not in flags:
            if "dirout" in offsets:
                self.direction = self.peek("dirout")
            elif "dirin" in offsets:
                self.direction = self.peek("dirin") ^ self.ones

    def peek(self, field: str) -> int:
        at = self.at[field]
        return int.from_bytes(self.memory[at : at + self.width], self.order)

    def load(self, field: str) -> int:
        got = self.peek(field)
        self.trace.append(("R", self.at[field], got))
        return got

    def store(self, field: str, value: int) -> None:
        at, value = self.at[field], value & self.ones
        self.memory[at : at + self.width] = value.to_bytes(self.width, self.order)
        self.trace.append(("W", at, value))

    def put(self, lines: int, high: int) -> None:
        """Set the lines of a mask to their bits in ``high``: by a pair of registers, or by the shadow."""
        self.data = ((self.data & ~lines) | (high & lines)) & self.ones
        self.store(self.output, self.data)

    def put_one(self, line: int, value: int) -> None:
        if self.pair:
            self.store("set" if value else "clr", line)
        else:
            self.put(line, line if value else 0)

    def put_many(self, lines: int, high: int) -> None:
        if not self.pair:
            return self.put(lines, high)
        for field, bits in (("set", high & lines), ("clr", ~high & lines & self.ones)):
            if bits:
                self.store(field, bits)

    def turn(self, line: int, out: bool) -> None:
        self.direction = (self.direction | line if out else self.direction & ~line) & self.ones
        for field, value in (("dirin", ~self.direction), ("dirout", self.direction)):
            if field in self.at:
                self.store(field, value)

    def is_out(self, line: int) -> bool:
        if "unreadable_dir" in self.flags:
            return bool(self.direction & line)
        if "dirout" in self.at:
            return bool(self.load("dirout") & line)
        return not self.load("dirin") & line

    def levels(self) -> int:
        return self.load("set" if "read_output_set" in self.flags else "dat")

    def call(self, table: str, args: dict[str, int]) -> tuple[int, int | None]:
        """(result, bits) of a callback."""
        line, value, bits, result = 1 << args.get("offset", 0), args.get("value", 0), args.get("bits"), 0
        match table.removeprefix("gpio_chip."):
            case "get":
                result = int(bool(self.levels() & line))
            case "get_multiple":
                bits = (args["bits"] & ~args["mask"]) | (self.levels() & args["mask"])
            case "set":
                self.put_one(line, value)
            case "set_multiple":
                self.put_many(args["mask"], args["bits"])
            case "direction_input":
                self.turn(line, False)
            case "direction_output":
                steps = [lambda: self.put_one(line, value), lambda: self.turn(line, True)]
                for step in reversed(steps) if "no_set_on_input" in self.flags else steps:
                    step()
            case "get_direction":
                result = int(not self.is_out(line))
            case _:
                raise ValueError(f"unsupported callback {table}")
        return result, bits


def bank_run(offsets, width, flags, plan, size: int) -> tuple | None:
    """A row of CALLS for a bank and its calls; null without a plan."""
    if plan is None:
        return None
    try:
        bank = Bank(dict(offsets or []), width, set(flags or []), size)
        start, calls = (bank.data, bank.direction), []
        for step in plan:
            bank.trace = []
            result, bits = bank.call(step["table"], {k: v for k, v in step["args"] if v is not None})
            calls.append((step["table"], bank.trace, result, bits, bank.data, bank.direction))
        return (*start, calls, None)
    except (KeyError, ValueError, TypeError, OverflowError) as e:
        return (None, None, [], f"{type(e).__name__}: {e}")


def bank_traces(cases: DataFrame, offsets: str, width: str, flags: str, plan: str, memory_bytes: int = 4096) -> DataFrame:
    """``cases`` with a struct column ``run`` (CALLS): what a bank's own driver does for a plan of callbacks.

    ``offsets`` is a map of register fields (dat, set, clr, dirin, dirout) to places,
    ``width`` 1 to 4 bytes, ``flags`` an array of big_endian, read_output_set,
    no_set_on_input, unreadable_set and unreadable_dir, ``plan`` an array of
    struct(table, args map). A bank without dat, or an unknown callback, gives an error.
    Calls share one state, so a plan is sequential; cases are independent, nothing is shuffled.
    """
    call = batched(lambda o, w, f, p: bank_run(o, w, f, p, memory_bytes), CALLS)
    return cases.withColumn("run", call(*map(F.col, (offsets, width, flags, plan))))


# ---- banked power management --------------------------------------------------------

# Register places, those that version 2 moves, and the bytes between the banks of each.
PM_REGISTERS = {"data": 0x00, "dir": 0x04, "inten": 0x30, "intmask": 0x34, "inttype": 0x38, "polarity": 0x3C, "debounce": 0x48, "eoi": 0x4C, "ext": 0x50}
PM_MOVED = {0x34: 0x44, 0x38: 0x34, 0x3C: 0x38, 0x40: 0x3C, 0x4C: 0x40}
PM_STRIDE = {"data": 0x0C, "dir": 0x0C, "ext": 0x04}
PM_SAVED = (("dir", "data", "ext"), ("intmask", "inten", "polarity", "inttype", "debounce"))
PM_RESTORED = (("data", "dir", "ext"), ("inttype", "polarity", "debounce", "inten", "intmask"))


def seed_word(offset: Column) -> Column:
    """The little-endian 32-bit word of the test memory image at a place."""
    byte = lambda i: F.shiftleft(((offset + i) * 37 + 0x5A).bitwiseAND(0xFF).cast("bigint"), 8 * i)
    return byte(0) + byte(1) + byte(2) + byte(3)


def power_traces(cases: DataFrame, key: list[str], flags: str, ports: str) -> DataFrame:
    """(key, phase, step, kind, offset, value): what suspending and then resuming the banks of a controller reads and writes.

    ``ports`` is an array of bank numbers, 0 to 3, each at most once; bit 0 of ``flags``
    tells version 2. Suspend saves every bank's registers, bank 0 also the interrupt ones,
    and masks what is no wake-up source (bank number k of the array wakes 0x01010101 (k + 1));
    resume writes back what was saved. No bank's register lies where another one is written
    before it is read, so each value is a function of its place and nothing is sequential.
    """
    v2 = F.col(flags).bitwiseAND(1) == 1
    moved = F.create_map(*[F.lit(x).cast("bigint") for kv in PM_MOVED.items() for x in kv])
    place = lambda o: F.when(v2, F.coalesce(F.element_at(moved, o), o)).otherwise(o)
    access = lambda kind, o, value: F.struct(F.lit(kind).alias("kind"), o.alias("offset"), value.alias("value"))

    def at(register: str) -> Column:
        return place(F.lit(PM_REGISTERS[register]).cast("bigint") + F.col("_bank").cast("bigint") * PM_STRIDE.get(register, 0))

    def rows(kind: str, every, first, then) -> Column:
        many, one = ([access(kind, at(r), seed_word(at(r))) for r in rs] for rs in (every, first))
        return F.concat(F.array(*many), F.when(F.col("_bank") == 0, F.array(*one, then)).otherwise(F.array().cast(f"array<{ACCESS}>")))

    wake = F.lit(0xFFFFFFFF).cast("bigint") - (F.col("_k") + 1).cast("bigint") * 0x01010101
    saved = rows("R", *PM_SAVED, access("W", at("intmask"), wake))
    restored = rows("W", *PM_RESTORED, access("W", at("eoi"), F.lit(0xFFFFFFFF).cast("bigint")))
    phases = F.array(F.struct(F.lit("suspend").alias("phase"), saved.alias("rows")), F.struct(F.lit("resume").alias("phase"), restored.alias("rows")))
    # bank 0 gives 9 rows, any other 3, so the number of a row is known without sorting
    before = F.expr(f"aggregate(slice({ports}, 1, _k), 0, (n, b) -> n + if(b = 0, 9, 3))")
    each = cases.select(*key, flags, ports, F.posexplode(ports).alias("_k", "_bank")).withColumn("_before", before)
    per = each.select(*key, "_before", F.inline(phases)).select(*key, "_before", "phase", F.posexplode("rows").alias("_n", "_a"))
    # a resumed bank 0 has 9 rows too: 3, 5 and the acknowledgement
    return per.select(*key, "phase", (F.col("_before") + F.col("_n")).alias("step"), "_a.kind", "_a.offset", "_a.value")


# ---- host port interface ------------------------------------------------------------

# Registers of the port.
HPI_DATA, HPI_ADDR = 0, 2


def port_traces(mode: Column, step: Column, register: Column, value: Column, current: Column) -> Column:
    """array of ACCESS: what a helper of the host port does, by ``mode``; null for any other.

    read and write touch a port register; read_reg and write_reg go through the address
    register; set_bits reads a register (``current``) and writes it with ``value`` added.
    ``step`` is the distance of the port's registers; written values have 16 bits.
    """
    access = lambda kind, port, v: F.struct(F.lit(kind).alias("kind"), (port * step).cast("bigint").alias("offset"), v.cast("bigint").alias("value"))
    word = value.bitwiseAND(0xFFFF)
    select = access("W", F.lit(HPI_ADDR), register)
    return (
        F.when(mode == "read", F.array(access("R", register, current))).when(mode == "write", F.array(access("W", register, word)))
        .when(mode == "read_reg", F.array(select, access("R", F.lit(HPI_DATA), current)))
        .when(mode == "write_reg", F.array(select, access("W", F.lit(HPI_DATA), word)))
        .when(mode == "set_bits", F.array(select, access("R", F.lit(HPI_DATA), current), select, access("W", F.lit(HPI_DATA), current.bitwiseOR(value).bitwiseAND(0xFFFF))))
    )
