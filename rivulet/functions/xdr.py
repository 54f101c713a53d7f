"""Reading and writing the base64 wire form of event topics and values, as column expressions.

A value is a 4-byte tag and a body, big-endian. Everything is done on the bytes in the JVM: there is
no Python worker in the decode job.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.amounts import BASE, big, signed_text
from rivulet.functions.stage import settle

# Fixed values of the wire format: tags, and the body sizes in bytes of the fixed-size tags.
TAG_U64, TAG_I128, TAG_BYTES, TAG_STRING, TAG_SYMBOL, TAG_VEC, TAG_MAP, TAG_ADDRESS = 5, 10, 13, 14, 15, 16, 17, 18
BODY_BYTES = {0: 4, 1: 0, 2: 8, 3: 4, 4: 4, 5: 8, 6: 8, 7: 8, 8: 8, 9: 16, 10: 16, 11: 32, 12: 32, 20: 0, 21: 8}
# Bytes behind the form of an address: account, contract, account with a number, balance, pool.
ADDRESS_BYTES = {0: 36, 1: 32, 2: 40, 3: 36, 4: 32}
ADDRESS_ACCOUNT, ADDRESS_CONTRACT = 0, 1
ACCOUNT_VERSION, CONTRACT_VERSION = 6 << 3, 2 << 3
CRC_POLYNOMIAL = 0x1021
BASE32_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RADIX32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def tag_hex(tag: int) -> str:
    return f"{tag:08X}"


def text_literals(text: str) -> list[str]:
    """The base64 forms in which a short name may appear as a topic (as a symbol or as a string)."""
    raw = text.encode()
    padded = raw + b"\0" * (-len(raw) % 4)
    return [
        base64.b64encode(tag.to_bytes(4, "big") + len(raw).to_bytes(4, "big") + padded).decode()
        for tag in (TAG_SYMBOL, TAG_STRING)
    ]


def bytes_of(base64_text: Column) -> Column:
    """The bytes, null when the text is not base64."""
    return F.try_to_binary(base64_text, F.lit("base64"))


def _unsigned(digits: Column) -> Column:
    return F.conv(digits, 16, 10)


def _slice(digits: Column, start: int | Column, length: int | Column) -> Column:
    """A piece of a text or of bytes, counted from 1."""
    start = start if isinstance(start, Column) else F.lit(start)
    length = length if isinstance(length, Column) else F.lit(length)
    return F.substring(digits, start, length)


# -- maps -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """A map value whose fields have known keys and sizes: where each field is, and what lies between."""

    size: int
    fields: dict[str, tuple[int, int]]  # name -> start of the tag (from 1) and length with the tag
    fixed: tuple[tuple[int, bytes], ...]  # start and content of every key with the tag that follows

    @staticmethod
    def of(types: dict[str, tuple[bytes, int]]) -> Layout:
        """From name -> (tag bytes, body bytes after them); keys are in sorted order on the wire."""
        at = 1
        pending = bytes.fromhex(tag_hex(TAG_MAP) + "00000001" + f"{len(types):08X}")
        fields, fixed = {}, []
        for name in sorted(types):
            tag, body = types[name]
            pending += bytes.fromhex(symbol_hex(name))
            fields[name] = (at + len(pending), len(tag) + body)
            fixed.append((at, pending + tag))
            at += len(pending) + len(tag) + body
            pending = b""
        return Layout(at - 1, fields, tuple(fixed))

    def fits(self, value: Column) -> Column:
        """Whether the bytes are exactly of this form."""
        test = F.octet_length(value) == self.size
        for start, content in self.fixed:
            test = test & (_slice(value, start, len(content)) == F.lit(content))
        return test


U64 = (bytes.fromhex(tag_hex(TAG_U64)), 8)
I128 = (bytes.fromhex(tag_hex(TAG_I128)), 16)
ACCOUNT = (bytes.fromhex(tag_hex(TAG_ADDRESS) + tag_hex(ADDRESS_ACCOUNT)), 36)
CONTRACT = (bytes.fromhex(tag_hex(TAG_ADDRESS) + tag_hex(ADDRESS_CONTRACT)), 32)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, for use inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def map_entries(value: Column) -> Column:
    """The entries of a map value as ``array<struct<key, raw>>``, ``raw`` being the value's hex.

    Items sit end to end and their sizes differ, so all of them, nested ones too, are walked in order. ``open`` counts
    the items that the key or value at hand still needs: a vector or a map adds its own. A key that is not a
    name has a null ``key``. The walk stops at a truncated item; fields behind that are absent, and a decoder
    that needs them reports so.
    """
    size = F.octet_length(value)
    is_map = F.hex(_slice(value, 1, 8)) == tag_hex(TAG_MAP) + "00000001"
    claimed = _number_at(value, F.lit(9))
    # An item takes at least 4 bytes, so the value's own size bounds the number of steps.
    steps = F.floor(size / 4).cast("int")
    names = [tag_hex(TAG_SYMBOL), tag_hex(TAG_STRING)]

    def state_of(at, opened, in_key, key, value_at, entries) -> Column:
        return F.struct(
            at.cast("int").alias("at"), opened.cast("bigint").alias("open"), in_key.alias("in_key"),
            key.cast("string").alias("key"), value_at.cast("int").alias("value_at"), entries.alias("entries"),
        )

    def step(state: Column, _: Column) -> Column:
        at = state["at"]

        def with_head(tag: Column) -> Column:
            return F.struct(tag.alias("tag"), _width(value, at, tag).alias("width"), _children(value, at, tag).alias("more"))

        def moved(item: Column) -> Column:
            end, left = at + item["width"], state["open"] - 1 + item["more"]
            name = F.when(item["tag"].isin(names), _slice(value, at + 8, _number_at(value, at + 4).cast("int")).cast("string"))
            entry = F.struct(state["key"].alias("key"), F.hex(_slice(value, state["value_at"], end - state["value_at"])).alias("raw"))
            one, yes, no = F.lit(1), F.lit(True), F.lit(False)
            inside = state_of(end, left, state["in_key"], state["key"], state["value_at"], state["entries"])
            to_value = state_of(end, one, no, F.when(state["open"] == 1, name), end, state["entries"])
            to_key = state_of(end, one, yes, F.lit(None), end, F.array_append(state["entries"], entry))
            stop = state_of(size + 1, one, yes, F.lit(None), size + 1, state["entries"])
            on = F.when(left > 0, inside).when(state["in_key"], to_value).otherwise(to_key)
            return F.when((end <= size + 1) & (left >= 0), on).otherwise(stop)

        over = (at > size) | (F.size(state["entries"]) >= claimed)
        return F.when(over, state).otherwise(let(let(F.hex(_slice(value, at, 4)), with_head), moved))

    empty = F.array().cast("array<struct<key:string,raw:string>>")
    start = state_of(F.lit(13), F.lit(1), F.lit(True), F.lit(None), F.lit(13), empty)
    walked = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda state: state["entries"])
    return F.when(is_map & (claimed > 0) & (steps > 0), walked)


def _number_at(value: Column, at: Column) -> Column:
    return _unsigned(F.hex(_slice(value, at, 4))).cast("bigint")


def _padded(length: Column) -> Column:
    return F.floor((length + 3) / 4) * 4


def _width(value: Column, at: Column, tag: Column) -> Column:
    """Bytes of the tagged item at ``at`` without the items inside it; null when it cannot be told."""
    sizes = {tag_hex(kind): 4 + size for kind, size in BODY_BYTES.items()}
    fixed = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    addresses = F.create_map(*[F.lit(x) for kind, size in ADDRESS_BYTES.items() for x in (tag_hex(kind), 8 + size)])
    form = F.hex(_slice(value, at + 4, 4))
    width = (
        F.when(tag.isin([tag_hex(k) for k in (TAG_BYTES, TAG_STRING, TAG_SYMBOL)]), 8 + _padded(_number_at(value, at + 4)))
        .when(tag == tag_hex(TAG_ADDRESS), F.try_element_at(addresses, form))
        .when(tag.isin([tag_hex(k) for k in (TAG_VEC, TAG_MAP)]), F.when(form == tag_hex(0), 8).otherwise(12))
        .otherwise(F.try_element_at(fixed, tag))
    )
    return F.when(width <= 1 << 30, width).cast("int")


def _children(value: Column, at: Column, tag: Column) -> Column:
    """How many items sit inside the one at ``at``."""
    filled = F.hex(_slice(value, at + 4, 4)) == tag_hex(1)
    count = _number_at(value, at + 8)
    return F.when(filled & (tag == tag_hex(TAG_VEC)), count).when(filled & (tag == tag_hex(TAG_MAP)), 2 * count).otherwise(F.lit(0))


def entry(entries: Column, name: str) -> Column:
    """The raw value stored under a key; of two, the later."""
    found = F.filter(entries, lambda e: e["key"] == name)
    return F.try_element_at(found, F.lit(-1))["raw"]


# -- scalars --------------------------------------------------------------------------------------


def u64_text(raw: Column) -> Column:
    return F.when(F.startswith(raw, F.lit(tag_hex(TAG_U64))), _unsigned(_slice(raw, 9, 16)))


def with_i128_texts(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add decimal texts (key: new column) of signed 128-bit values (value: column of raw hex).

    With ``2^64 = 1844674 * 10^13 + 4073709551616`` both halves go to base 10^13, where nothing
    outgrows 38 digits. Stacked projections keep every intermediate a column of its own.
    """
    carry, rest = divmod(2**64, BASE)
    base = F.lit(BASE).cast("decimal(14,0)")
    kept = [c for c in frame.columns if c not in columns]
    halves, tails, digits, tops, texts = {}, {}, {}, {}, {}
    for name, raw in columns.items():
        tagged = F.startswith(raw, F.lit(tag_hex(TAG_I128)))
        # Most amounts fit the lower half, whose text comes straight from its digits.
        short = F.startswith(raw, F.lit(tag_hex(TAG_I128) + "0" * 16))
        good = tagged & ~short
        halves[f"_{name}_h"] = F.when(good, big(F.conv(_slice(F.col(raw), 9, 16), 16, -10)))
        halves[f"_{name}_l"] = F.when(good, big(_unsigned(_slice(F.col(raw), 25, 16))))
        tails[f"_{name}_t"] = big(F.col(f"_{name}_h") * F.lit(rest).cast("decimal(14,0)")) + F.col(f"_{name}_l")
        digits[f"_{name}_d"] = F.pmod(F.col(f"_{name}_t"), base)
        tops[f"_{name}_u"] = big(F.col(f"_{name}_h") * F.lit(carry).cast("decimal(7,0)")) + big(
            (F.col(f"_{name}_t") - F.col(f"_{name}_d")) / base
        )
        long = signed_text(F.col(f"_{name}_u"), F.col(f"_{name}_d"))
        texts[name] = F.when(short, _unsigned(_slice(F.col(raw), 25, 16))).otherwise(long)
    for step in (halves, tails, digits, tops, texts):
        frame = frame.withColumns(step)
    return settle(frame.select(*kept, *columns), list(columns))


# -- addresses ------------------------------------------------------------------------------------


def _crc_masks() -> tuple[list[list[int]], dict[int, int]]:
    """Per checksum bit the message bits it is the parity of, as 64-bit words; and the version's share.

    The checksum (CRC-16, start value 0) is linear, so each of its bits is the parity of a fixed
    choice of message bits. That turns the byte loop into sixteen ``bit_count`` calls.
    """

    def crc(message: bytes) -> int:
        value = 0
        for byte in message:
            value ^= byte << 8
            for _ in range(8):
                value = ((value << 1) ^ CRC_POLYNOMIAL if value & 0x8000 else value << 1) & 0xFFFF
        return value

    masks = [[0] * 4 for _ in range(16)]
    for position in range(256):
        key = (1 << (255 - position)).to_bytes(32, "big")
        effect = crc(b"\0" + key)
        for bit in range(16):
            if effect >> bit & 1:
                masks[bit][position // 64] |= 1 << (63 - position % 64)
    versions = {v: crc(bytes([v]) + b"\0" * 32) for v in (ACCOUNT_VERSION, CONTRACT_VERSION)}
    return masks, versions


def _signed64(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def with_addresses(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add address texts (key: new column) of raw hex columns: ``G...`` accounts, ``C...`` contracts.

    The text is base32 of the version byte, the 32-byte key and the checksum, low byte first.
    """
    masks, versions = _crc_masks()
    account = tag_hex(TAG_ADDRESS) + tag_hex(ADDRESS_ACCOUNT)
    contract = tag_hex(TAG_ADDRESS) + tag_hex(ADDRESS_CONTRACT)
    kept = [c for c in frame.columns if c not in columns]
    steps = {}
    for name, raw in columns.items():
        keys, words, sums, whole, texts = steps[name] = {}, {}, {}, {}, {}
        value, key, version = F.col(raw), F.col(f"_{name}_k"), F.col(f"_{name}_v")
        is_account = F.startswith(value, F.lit(account)) & (F.length(value) == 8 + 80)
        is_contract = F.startswith(value, F.lit(contract)) & (F.length(value) == 8 + 72)
        keys[f"_{name}_k"] = F.when(is_account, _slice(value, 25, 64)).when(is_contract, _slice(value, 17, 64))
        keys[f"_{name}_v"] = F.when(is_account, ACCOUNT_VERSION).when(is_contract, CONTRACT_VERSION)
        for i in range(4):
            words[f"_{name}_w{i}"] = F.conv(_slice(key, 1 + 16 * i, 16), 16, -10).cast("bigint")
        bits = [
            f"shiftleft(cast(bit_count({' ^ '.join(f'(_{name}_w{i} & {_signed64(m)}L)' for i, m in enumerate(mask))}) & 1 AS bigint), {bit})"
            for bit, mask in enumerate(masks)
        ]
        start = f"CASE WHEN _{name}_v = {ACCOUNT_VERSION} THEN {versions[ACCOUNT_VERSION]}L ELSE {versions[CONTRACT_VERSION]}L END"
        checksum = F.expr(" ^ ".join([start, *bits]))
        sums[f"_{name}_s"] = F.when(key.isNotNull(), F.lpad(F.hex(checksum), 4, "0"))
        tail = F.col(f"_{name}_s")
        whole[f"_{name}_b"] = F.concat(F.hex(version.cast("bigint")), key, _slice(tail, 3, 2), _slice(tail, 1, 2))
        groups = [F.lpad(F.conv(_slice(F.col(f"_{name}_b"), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(7)]
        texts[name] = F.translate(F.concat(*groups), RADIX32_DIGITS, BASE32_LETTERS)
    for name in columns:
        # One address after another: together they would make a method too long to be compiled well.
        before = [c for c in frame.columns if c != name]
        for step in steps[name]:
            frame = frame.withColumns(step)
        frame = settle(frame.select(*before, name), [name])
    return frame.select(*kept, *columns)


# -- writing --------------------------------------------------------------------------------------


def symbol_hex(text: str) -> str:
    return base64.b64decode(text_literals(text)[0]).hex().upper()


def u64_hex(value: Column) -> Column:
    return F.concat(F.lit(tag_hex(TAG_U64)), F.lpad(F.hex(value.cast("bigint")), 16, "0"))


def i128_hex(value: Column) -> Column:
    """A value below 2^63, as a 128-bit one."""
    return F.concat(F.lit(tag_hex(TAG_I128)), F.lpad(F.hex(value.cast("bigint")), 32, "0"))


def account_hex(key_hex: Column) -> Column:
    return F.concat(F.lit(tag_hex(TAG_ADDRESS) + tag_hex(ADDRESS_ACCOUNT) * 2), key_hex)


def map_hex(fields: dict[str, Column]) -> Column:
    """A map value; keys go in sorted order, as the wire form wants them."""
    parts = [F.lit(tag_hex(TAG_MAP) + "00000001" + f"{len(fields):08X}")]
    for name in sorted(fields):
        parts += [F.lit(symbol_hex(name)), fields[name]]
    return F.concat(*parts)


def to_base64(hex_text: Column) -> Column:
    return F.base64(F.unhex(hex_text))


