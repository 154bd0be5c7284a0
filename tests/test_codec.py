import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tilecask import errors as E
from tilecask.functions import codec
from tilecask.functions.tiles import MAX_TILE_ID, ids_of, pyramid_size, zxy_of

VECTORS = [
    (0, 0, 0, 0), (1, 1, 0, 4), (2, 1, 3, 11), (3, 3, 0, 26), (20, 0, 0, 366503875925), (21, 0, 0, 1466015503701), (28, 0, 0, 24019198012642645),
    (31, 0, 0, 1537228672809129301), (31, 2**31 - 1, 2**31 - 1, 4611686018427387903), (31, 0, 2**31 - 1, 3074457345618258602), (31, 2**31 - 1, 0, 6148914691236517204),
]


def test_tile_ids():
    z, x, y, ids = (np.array(c) for c in zip(*VECTORS, strict=True))
    assert ids_of(z, x, y).tolist() == ids.tolist()
    assert [a.tolist() for a in zxy_of(ids)] == [z.tolist(), x.tolist(), y.tolist()]
    some = np.r_[np.arange(1000), pyramid_size(31) - 1, pyramid_size(31), pyramid_size(31) + 1, MAX_TILE_ID - 1, MAX_TILE_ID]
    assert (ids_of(*zxy_of(some)) == some).all()


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_varints(values):
    data = codec.encode_varints(np.array(values, np.uint64))
    got, used = codec.decode_varints(data + b"\x05")
    assert got.tolist()[: len(values)] == values and used == len(data) + 1


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 60), st.integers(0, 20), st.integers(0, 3)), max_size=40))
def test_directory_round_trip(rows):
    a = np.array(rows, np.int64).reshape(-1, 4)
    a[:, 0] = np.cumsum(a[:, 0])
    got = codec.decode_directory(codec.encode_directory(*a.T))
    assert all((got[n] == a[:, i]).all() for i, n in enumerate(("tile_id", "offset", "length", "run_length")))


@pytest.mark.parametrize(
    ("entries", "probe", "at"),
    [([], 0, None), ([(100, 1)], 100, 0), ([(100, 1)], 101, None), ([(100, 2)], 101, 0), ([(100, 1), (150, 2)], 151, 1), ([(50, 2), (100, 1), (150, 1)], 51, 0), ([(100, 0)], 150, 0), ([(0, 5), (2, 1)], 3, None)],
)
def test_find(entries, probe, at):
    a = np.array(entries, np.int64).reshape(-1, 2)
    assert codec.find({"tile_id": a[:, 0], "run_length": a[:, 1]}, probe) == at


def test_header_round_trip_and_errors():
    h = codec.Header(n_tile_entries=7, tile_type="Png", min_longitude=11.154026, max_latitude=43.8325455)
    data = h.encode()
    assert len(data) == 127 and codec.decode_header(data) == h
    for bad, error in ((b"XX" + data[2:], E.InvalidMagicNumber), (b"PM" + bytes(125), E.UnsupportedVersion), (data[:3], E.InvalidHeader), (data[:126], E.InvalidHeader), (data[:97] + b"\5" + data[98:], E.InvalidCompression), (data[:99] + b"\7" + data[100:], E.InvalidTileType)):
        with pytest.raises(error):
            codec.decode_header(bad)


def test_bad_directories():
    for bad in (b"", b"\x05", codec.encode_varints(np.array([1, 0, 1, 1, 0])), codec.encode_varints(np.array([2, 0, 1, 1]))):
        with pytest.raises(E.InvalidEntry):
            codec.decode_directory(bad)
    with pytest.raises(E.IndexEntryOverflow):
        codec.encode_directory([0], [0], [1 << 32], [1])


def test_compressions():
    for name in ("None", "Gzip", "Zstd"):
        assert codec.decompress(name, codec.compressor(name)(b"abc" * 99)) == b"abc" * 99
    for name in ("Unknown", "Brotli"):
        with pytest.raises(E.UnsupportedCompression):
            codec.compressor(name)(b"")
    with pytest.raises(E.ReadingError):
        codec.decompress("Gzip", b"no")
