"""A sequence header written and read field by field; presence and place of a field hang on earlier values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U, UE, SE, ALIGN = range(4)
# Fixed format: the fields of a sequence parameter set of intra pictures in their order: name, kind, digits, and the
# earlier field with the lowest and highest value with which it is there.
FIELDS = [
    ("sps_id", U, 4), ("vps_id", U, 4), ("max_sublayers_minus1", U, 3), ("chroma_format_idc", U, 2), ("log2_ctu_size_minus5", U, 2), ("ptl_present", U, 1), ("profile_idc", U, 7), ("tier", U, 1), ("level_idc", U, 8),
    ("frame_only", U, 1), ("multilayer", U, 1), ("gci_present", U, 1), ("ptl_alignment", ALIGN, 0), ("num_sub_profiles", U, 8), ("gdr", U, 1), ("resampling", U, 1), ("coded_width", UE, 0), ("coded_height", UE, 0),
    ("conformance_window", U, 1), ("crop_left", UE, 0, "conformance_window", 1, 1), ("crop_right", UE, 0, "conformance_window", 1, 1), ("crop_top", UE, 0, "conformance_window", 1, 1), ("crop_bottom", UE, 0, "conformance_window", 1, 1),
    ("subpictures", U, 1), ("bit_depth_minus8", UE, 0), ("entropy_sync", U, 1), ("entry_points", U, 1), ("log2_max_poc_minus4", U, 4), ("poc_msb", U, 1), ("extra_ph_bytes", U, 2), ("extra_sh_bytes", U, 2),
    ("dpb_size_minus1", UE, 0), ("dpb_reorder", UE, 0), ("dpb_latency_plus1", UE, 0), ("log2_min_cb_minus2", UE, 0), ("partition_override", U, 1), ("min_qt_luma", UE, 0), ("mtt_depth_luma", UE, 0),
    ("max_bt_luma", UE, 0, "mtt_depth_luma", 1, 99), ("max_tt_luma", UE, 0, "mtt_depth_luma", 1, 99), ("dual_tree", U, 1, "chroma_format_idc", 1, 3), ("min_qt_chroma", UE, 0, "dual_tree", 1, 1), ("mtt_depth_chroma", UE, 0, "dual_tree", 1, 1),
    ("max_bt_chroma", UE, 0, "mtt_depth_chroma", 1, 99), ("max_tt_chroma", UE, 0, "mtt_depth_chroma", 1, 99), ("min_qt_inter", UE, 0), ("mtt_depth_inter", UE, 0), ("max_transform_64", U, 1, "log2_ctu_size_minus5", 1, 3),
    ("transform_skip", U, 1), ("log2_ts_size_minus2", UE, 0), ("bdpcm", U, 1), ("mts", U, 1), ("mts_intra", U, 1, "mts", 1, 1), ("mts_inter", U, 1, "mts", 1, 1), ("lfnst", U, 1), ("joint_chroma", U, 1, "chroma_format_idc", 1, 3),
    ("same_qp_table", U, 1, "chroma_format_idc", 1, 3), ("qp_table_start_minus26", SE, 0, "chroma_format_idc", 1, 3), ("qp_table_points_minus1", UE, 0, "chroma_format_idc", 1, 3), ("qp_delta_in_minus1", UE, 0, "chroma_format_idc", 1, 3),
    ("qp_delta_diff", UE, 0, "chroma_format_idc", 1, 3), ("sao", U, 1), ("alf", U, 1), ("lmcs", U, 1), ("weighted_pred", U, 1), ("weighted_bipred", U, 1), ("long_term", U, 1), ("idr_rpl", U, 1), ("rpl1_same", U, 1), ("ref_pic_lists", UE, 0),
    ("wraparound", U, 1), ("temporal_mvp", U, 1), ("amvr", U, 1), ("bdof", U, 1), ("smvd", U, 1), ("dmvr", U, 1), ("mmvd", U, 1), ("six_minus_merge", UE, 0), ("sbt", U, 1), ("affine", U, 1), ("bcw", U, 1), ("ciip", U, 1), ("gpm", U, 1),
    ("parallel_merge_minus2", UE, 0), ("isp", U, 1), ("mrl", U, 1), ("mip", U, 1), ("cclm", U, 1, "chroma_format_idc", 1, 3), ("collocated_across", U, 1, "chroma_format_idc", 1, 1), ("collocated_down", U, 1, "chroma_format_idc", 1, 1),
    ("palette", U, 1), ("min_qp_ts_minus4", UE, 0), ("ibc", U, 1), ("ladf", U, 1), ("scaling_lists", U, 1), ("dependent_quant", U, 1),
]
NAMES = [f[0] for f in FIELDS]


#: No header is longer: a code of 62 zeros is the longest whose number fits.
ZEROS = 62
LONGEST = sum(width if kind == U else 7 if kind == ALIGN else 2 * ZEROS + 1 for _, kind, width, *_ in FIELDS)
#: Headers that are read side by side.
SIDE = 2000


def written(values: str) -> Column:
    """The bits of a header, as text, of an array of a value for each field; those of absent fields are not used.

    Which fields are there hangs on values alone, so each one's digits are an expression by itself.
    """

    def here(k: int) -> str:
        on, low, high = FIELDS[k][3:]
        j = NAMES.index(on)
        there = f"get({values}, {j}) BETWEEN {low} AND {high}"
        return f"coalesce({f'{here(j)} AND {there}' if FIELDS[j][3:] else there}, false)"

    bits = "''"
    for k, (_, kind, width, *rule) in enumerate(FIELDS):
        if kind == ALIGN:
            bits = f"rpad(concat({bits}), (length(concat({bits})) + 7) div 8 * 8, '0')"
            continue
        v = f"get({values}, {k})"
        number = f"bin(if({v} > 0, 2 * {v}, 1 - 2 * {v}))" if kind == SE else f"bin({v} + 1)"
        code = f"lpad(bin({v}), {width}, '0')" if kind == U else f"concat(repeat('0', length({number}) - 1), {number})"
        bits += ", " + (f"if({here(k)}, {code}, '')" if rule else code)
    return F.expr(f"concat({bits})")


def _side_by_side(bits: pa.Array) -> pa.Array:
    """The structs of ``read`` for some headers: field after field, each for all headers at once."""
    text = bits.cast(pa.large_string())
    places = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]
    known = np.asarray(text.is_valid())
    start, end = places[:-1] - places[0], places[1:] - places[0]
    one = np.concatenate([raw == ord("1"), np.zeros(8, bool)])  # so that there are eight digits after every place
    eight = sum(one[k : len(raw) + k + 1].astype(np.int64) << (7 - k) for k in range(8))
    first = np.minimum.accumulate(np.where(one, np.arange(len(one)), len(one) + 2 * LONGEST)[::-1])[::-1]

    def number(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        v = np.zeros(len(at), np.int64)
        while (left > 0).any():
            n = np.clip(left, 0, 8)
            v, at, left = (v << n) | (eight[np.minimum(at, len(raw))] >> (8 - n)), at + n, left - n
        return v

    at, bad = start.copy(), ~known
    out, there = np.zeros((len(FIELDS), len(text)), np.int64), np.zeros((len(FIELDS), len(text)), bool)
    for k, (_, kind, width, *rule) in enumerate(FIELDS):
        here = ~bad
        if rule:
            on = NAMES.index(rule[0])
            here &= there[on] & (rule[1] <= out[on]) & (out[on] <= rule[2])
        zeros = first[np.minimum(at, len(raw))] - at if kind in (UE, SE) else 0
        used = width if kind == U else -(at - start) % 8 if kind == ALIGN else np.where(zeros > ZEROS, LONGEST + 1, 2 * zeros + 1)
        fits = at + used <= end
        bad |= here & ~fits
        here &= fits
        if kind != ALIGN:
            there[k] = here
            code = number(at + zeros, np.where(here, width if kind == U else zeros + 1, 0)) - (kind != U)
            out[k] = np.where(code % 2 == 1, (code + 1) // 2, -(code // 2)) if kind == SE else code
        at = np.where(here, at + used, at)
    values = pa.array(out.T.ravel(), pa.int64(), mask=~there.T.ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * len(FIELDS)), values)
    return pa.StructArray.from_arrays([pa.array(at - start, pa.int32()), lists, pa.array(bad, pa.bool_(), mask=~known)], ["at", "out", "bad"])


def _read(bits: pa.Array) -> pa.Array:
    return pa.concat_arrays([_side_by_side(bits.slice(k, SIDE)) for k in range(0, max(len(bits), 1), SIDE)])


def read(column: str) -> Column:
    """Struct (at, out, bad) of the bits in ``column``: digits read, each field's value (null: absent or cut off), and whether the header is cut off.

    Nothing is read after the first field that does not fit. Where a field begins hangs on all before it, so headers are
    read side by side, a batch at a time; a fold over a header's fields took a millisecond each.
    """
    return F.arrow_udf(_read, "at int, out array<bigint>, bad boolean")(F.substring(column, 1, LONGEST))


def summary(header: Column) -> dict[str, Column]:
    """What a decoder takes from a header that was ``read``; ``error`` is null if it can be used, and else all others are."""
    of = lambda name: header["out"][NAMES.index(name)]
    idc, crop = of("chroma_format_idc"), lambda name: F.coalesce(of(name), F.lit(0))
    width = of("coded_width") - crop("crop_right") * F.when(idc.isin(1, 2), 2).otherwise(1)
    height = of("coded_height") - crop("crop_bottom") * F.when(idc == 1, 2).otherwise(1)
    depth = of("bit_depth_minus8") + 8
    error = F.when(header["bad"], "cut off").when(~depth.isin(8, 10, 12), "bit depth").when((width < 0) | (height < 0), "bad crop")
    flag = lambda name: F.coalesce(of(name), F.lit(0)) > 0
    found = {"idc": idc, "width": width, "height": height, "depth": depth, "lossless": flag("bdpcm"), "mtt": flag("mtt_depth_luma"), "lfnst": flag("lfnst"), "dep_quant": flag("dependent_quant"), "mts": flag("mts"), "dual_tree": flag("dual_tree"), "cclm": flag("cclm")}
    return {"error": error} | {k: F.when(error.isNull(), c) for k, c in found.items()}
