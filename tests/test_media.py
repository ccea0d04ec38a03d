"""Masks against a flood fill, tensor files against what was written, features of clips by written-out cases."""

import io

import numpy as np
import pytest

from tidemark.operators import features, masks
from tidemark.sources import tensors


def flood(mask):
    """Size of each part of equal pixels and whether it reaches the edge, by a stack."""
    h, w = mask.shape
    seen, parts = np.zeros((h, w), bool), []
    for r in range(h):
        for c in range(w):
            if seen[r, c]:
                continue
            stack, n, edge = [(r, c)], 0, False
            seen[r, c] = True
            while stack:
                y, x = stack.pop()
                n, edge = n + 1, edge or y in (0, h - 1) or x in (0, w - 1)
                for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= a < h and 0 <= b < w and not seen[a, b] and mask[a, b] == mask[r, c]:
                        seen[a, b] = True
                        stack.append((a, b))
            parts.append((bool(mask[r, c]), n, edge))
    return parts


def expected(mask):
    parts = flood(mask)
    on = [n for fg, n, _ in parts if fg]
    fg, holes = sum(on), sum(n for is_on, n, edge in parts if not is_on and not edge)
    return fg, len(on), max(on, default=0) / max(fg, 1), holes / max(fg + holes, 1), sum(n / fg >= 0.02 for n in on)


def test_measures_by_flood_fill():
    rng = np.random.default_rng(3)
    cases = [rng.random((rng.integers(1, 24), rng.integers(1, 24))) < p for p in np.linspace(0, 1, 60)]
    spiral = np.zeros((21, 21), bool)
    for i in range(0, 10, 2):
        spiral[i, i : 21 - i] = spiral[i : 21 - i, 20 - i] = spiral[20 - i, i : 21 - i] = spiral[i + 2 : 21 - i, i] = True
        spiral[i + 2, i : i + 2] = True
    cases += [spiral, ~spiral, np.indices((15, 15)).sum(0) % 2 == 0, np.zeros((0, 0), bool), np.zeros((0, 5), bool), np.ones((1, 1), bool)]
    assert [tuple(r) for r in masks.measures(cases).itertuples(index=False)] == [pytest.approx(expected(m)) for m in cases]


def judged(spark, rows, **settings):
    schema = "crop string, height int, width int, mask binary, fg_area string"
    found = masks.mask_quality(spark.createDataFrame([(k, *m.shape, m.astype(np.uint8).tobytes(), "clash") if m is not None else (k, 4, 4, None, None) for k, m in rows], schema), ["crop"], **settings)
    return {r.crop: r for r in found.collect()}


def test_mask_gate(spark):
    solid, island, holed = (np.zeros((60, 70), bool) for _ in range(3))
    solid[5:50, 7:60] = True
    island[:50, :20] = True
    island[55:, 60:] = True
    holed[5:55, 5:65] = True
    holed[20:40, 20:50] = False
    open_ = holed.copy()
    open_[30, 40:] = False
    corner = np.zeros((40, 40), bool)
    corner[:20, :20] = corner[20:, 20:] = True
    got = judged(spark, [("solid", solid), ("island", island), ("holed", holed), ("open", open_), ("corner", corner), ("none", np.zeros((3, 3), bool)), ("null", None)])
    assert {k: r.reasons for k, r in got.items()} == {
        "solid": [], "island": ["too_many_fragments"], "holed": ["interior_holes"], "open": [],
        "corner": ["largest_cc_too_small", "too_many_fragments"], "none": ["empty_mask"], "null": ["empty_mask"],
    }
    assert got["solid"].ok and got["open"].ok and not got["null"].ok
    assert got["holed"].hole_share == pytest.approx(600 / 3000) and got["corner"].largest_share == 0.5
    assert judged(spark, [("corner", corner)], least_largest=0.5, most_parts=2)["corner"].ok
    assert judged(spark, []) == {}


def test_masks_that_do_not_fit(spark):
    rows = spark.createDataFrame([("a", 2, 2, bytearray(3))], "crop string, height int, width int, mask binary")
    with pytest.raises(Exception, match="can't be 2 by 2"):
        masks.mask_quality(rows, ["crop"]).collect()


def test_slices_keep_order(spark, monkeypatch):
    monkeypatch.setattr(masks, "SLICE", 5)
    grids = [(str(i), np.arange(i * 2).reshape(2, i) % 3 > 0) for i in range(12)]
    got = {k: (r.fg_area, r.n_parts) for k, r in judged(spark, grids).items()}
    assert got == {k: expected(m)[:2] for k, m in grids}


def test_safetensors_files(spark, tmp_path):
    half = np.array([1.5, -2.0], np.float32)
    plain = [("a", half), ("b", np.arange(6, dtype=np.int16).reshape(2, 3)), ("c", np.array([True, False])), ("d", np.array([], np.float64))]
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "e.safetensors").write_bytes(tensors.to_safetensors(plain))
    bf16 = b'{"__metadata__":{"k":"v"},"x":{"dtype":"BF16","shape":[2],"data_offsets":[0,4]}}'
    raw = (half.view(np.uint32) >> 16).astype("<u2").tobytes()
    (tmp_path / "other.safetensors").write_bytes(len(bf16).to_bytes(8, "little") + bf16 + raw)
    (tmp_path / "notes.txt").write_text("no tensors")
    got = {r.key: list(r.vec) for r in tensors.read_vectors(spark, str(tmp_path)).collect()}
    assert got == {"a": [1.5, -2.0], "b": [0, 1, 2, 3, 4, 5], "c": [1, 0], "d": [], "x": [1.5, -2.0]}
    assert [r.key for r in tensors.read_vectors(spark, str(tmp_path), ["c", "zz"]).collect()] == ["c"]


def test_broken_tensor_files(spark):
    whole = tensors.to_safetensors([("a", np.ones(4))])
    with pytest.raises(ValueError, match="cut short"):
        list(tensors.from_safetensors(whole[:-1], lambda n: True))
    with pytest.raises(ValueError, match="not a safetensors"):
        list(tensors.from_safetensors(b"", lambda n: True))
    with pytest.raises(ValueError, match="two tensors"):
        tensors.to_safetensors([("a", np.ones(1)), ("a", np.ones(1))])
    assert tensors.vectors(spark.createDataFrame([("p", None)], "path string, content binary")).count() == 0


def test_vector_blobs_keep_every_row(spark):
    rows = spark.createDataFrame([(i % 7 if i != 3 else None, [float(i), -1.0] if i != 5 else None) for i in range(40)], "id long, v array<double>").coalesce(1)
    blobs = tensors.vector_blobs(rows, "id", "v", most=4)
    assert blobs.count() == len({r.path for r in blobs.collect()}) > 9
    back = sorted((r.key, list(r.vec)) for r in tensors.vectors(blobs).collect())
    assert back == sorted((str(i % 7), [float(i), -1.0]) for i in range(40) if i not in (3, 5))


def npz(**arrays):
    out = io.BytesIO()
    np.savez(out, **{k.replace("_of_", "__"): np.asarray(v, np.float32 if k != "faceok_of_E1" else bool) for k, v in arrays.items()})
    return out.getvalue()


def test_features_of_clips(spark, tmp_path):
    folder = tmp_path / "embed" / "clips" / "base" / "0007"
    folder.mkdir(parents=True)
    one = npz(frame_dino=[[1, 0], [0, 1]], frame_megaloc=[[0, 1], [0, 1]], score_of_E1=[0.9, 0.1], box_of_E1=[[0, 0, 1, 1]] * 2, crop_of_E1=[[1, 0], [0, 1]], faceok_of_E1=[False, True], face_of_E1=[[0, 0], [1, 0]], score_of_E2=[0.5, 0.5], crop_of_E2=[[0, 1], [0.6, 0.8]])
    (folder / "gt003_a.npz").write_bytes(one)
    (folder / "gt012_b.npz").write_bytes(npz(frame_dino=[[0.6, 0.8]], score_of_E1=[0.4], crop_of_E1=[[0.8, 0.6]]))
    (folder / "gt013_b.npz").write_bytes(npz(error=[1], frame_dino=[[1, 0]]))
    blobs = tensors.files(spark, str(tmp_path), "*.npz")
    frames, ents = tensors.frame_features(blobs), tensors.entity_features(blobs)
    assert sorted((r.cond, r.story, r.gt, r.variant, r.frame, r.place_vec) for r in frames.collect()) == [("base", "0007", 3, "a", 0, [0, 1]), ("base", "0007", 3, "a", 1, [0, 1]), ("base", "0007", 12, "b", 0, None)]
    rows = {(r.gt, r.eid, r.frame): r for r in ents.collect()}
    assert sorted(rows) == [(3, "E1", 0), (3, "E1", 1), (3, "E2", 0), (3, "E2", 1), (12, "E1", 0)]
    assert rows[3, "E1", 0].face is None and rows[3, "E1", 1].face == [1, 0] and rows[3, "E2", 0].box is None

    found = features.modality_vectors(ents, frames, 0.25)
    side = lambda gt, variant, eid: ("base", "0007", gt, variant, eid)
    sort = "struct<cond:string,story:string,gt:int,variant:string,eid:string>"
    units = [("u1", "character", side(3, "a", "E1"), side(12, "b", "E1")), ("u2", "character", side(3, "a", "E2"), side(13, "b", "E2")), ("u3", "location", side(3, "a", None), side(12, "b", None)), ("u4", None, side(3, "a", "E1"), side(3, "a", "E1"))]
    got = features.unit_similarities(spark.createDataFrame(units, f"unit string, kind string, a {sort}, b {sort}"), found, {"dino_crop": ["character"], "face": ["character"], "location_dino": ["location"]})
    assert sorted((r.unit, r.modality, r.det_a, r.det_b, r.sim if r.sim is None else round(r.sim, 5)) for r in got.collect()) == [
        ("u1", "dino_crop", True, True, 0.8), ("u1", "face", False, False, None), ("u2", "dino_crop", True, False, None), ("u2", "face", False, False, None), ("u3", "location_dino", True, True, 0.8),
    ]
