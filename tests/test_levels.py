import pytest

from blockloom.functions.levels import CodecConfig, InvalidParameter, InvalidWidth, level_shift


def test_configuration():
    assert CodecConfig().with_(level=99).level == 9 and CodecConfig().with_(level=-1).level == 0
    assert [level_shift(x) for x in range(10)] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4]
    with pytest.raises(InvalidParameter):
        CodecConfig().with_(shift=16)
    with pytest.raises(InvalidParameter):
        CodecConfig(shift=15).superblock_bytes(8)
    for width in (0, 65535):
        with pytest.raises(InvalidWidth):
            CodecConfig().superblock_bytes(width)
    assert CodecConfig(level=9).superblock_bytes(8, 10**9) == 131072 << 4
