"""Known cases of keys, sealing and containers. Hexadecimal keys, nonces, texts and results below."""

import pytest

from ledgerloom.functions import crypto
from ledgerloom.sources import container

KEY, NONCE = bytes.fromhex("b52c505a37d78eda5dd34f20c22540ea1b58963cf8e5bf8ffa85f9f2492505b4"), bytes.fromhex("516c33929df5a3284ff463d7")
BLOCK, AAD = bytes(range(16)), bytes(range(0x20, 0x30))
SEALED = [
    (b"", b"", "", "bdc1ac884d332457a1d2664f168c76f0"),
    (BLOCK, b"", "e69c8e689b8eb63863f5c32d01dcca1f", "5d8629be177ace8460f9d0d3cd00d9a8"),
    (b"", AAD, "", "7df03a034192fc545dc1d76279a02b50"),
    (b"B", b"", "a4", "f955d254cba1095f14cf5decee1dfd3e"),
    (BLOCK, AAD, "e69c8e689b8eb63863f5c32d01dcca1f", "23d8effe8354cb1cf8b419601118c616"),
]


@pytest.mark.parametrize(("plain", "aad", "text", "tag"), SEALED)
def test_aes_gcm(spark, plain, aad, text, tag):
    box = crypto.seal(spark, plain, KEY, NONCE, aad)
    assert box.hex() == text + tag and crypto.open_(spark, box, KEY, NONCE, aad) == plain


@pytest.mark.parametrize("change", [lambda b, a: (b[:-16] + bytes([b[-16] ^ 0xFF]) + b[-15:], a), lambda b, a: (bytes([b[0] ^ 0xFF]) + b[1:], a), lambda b, a: (b, bytes([a[0] ^ 0xFF]) + a[1:])])
def test_changed_boxes_do_not_open(spark, change):
    box, aad = change(bytes.fromhex("e69c8e689b8eb63863f5c32d01dcca1f23d8effe8354cb1cf8b419601118c616"), AAD)
    with pytest.raises(crypto.AuthenticationError):
        crypto.open_(spark, box, KEY, NONCE, aad)


PRK = "077709362c2e32df0ddc3f0dc47bba6390b6c73bb50f9c3122ec844ad7c2b3e5"
EXPANDED = [
    (PRK, "f0f1f2f3f4f5f6f7f8f9", 42, "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"),
    ("19ef24a32c717b167f33a91d6f648bdf96596776afdb6377ac434c1c293ccb04", "", 42, "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"),
    ("b8f58bb59550f5bd61aa8b38d441bb5b00c05ad8c0fafea9fb82d61e55911e8b", "70662f64622f31", 32, "a066fff5d232662a27af2fcca1cc6b5eb05f281ebfae180627cc65eda78df52a"),
    (PRK, "", 1, "b2"),
    (PRK, "70662f64622f31", 33, "9f5b2c3e9bb47f9e0dcf5df63b56a87bffffc843527c15cbfbb17433ca7b4ddc3e"),
    (PRK, "", 64, "b2a3d45126d31fb6828ef00d76c6d54e9c2bd4785e49c6ad86e327d89d0de9408eeda1cbef2b03f30e053d5be784c2ab37f5a4de412baa10f01f456e9772aae7"),
]


@pytest.mark.parametrize(("prk", "info", "size", "out"), EXPANDED)
def test_hkdf(prk, info, size, out):
    assert crypto.hkdf_expand(bytes.fromhex(prk), bytes.fromhex(info), size).hex() == out


def test_hkdf_without_salt():
    assert crypto.hkdf_extract(b"", bytes([11]) * 22).hex() == EXPANDED[1][0] and crypto.hkdf_extract(b"", b"B" * 32).hex() == EXPANDED[2][0]


MASTER, DATA = bytes.fromhex("3d7fa1c29b04e5f67a83c1d90b254e68f7a2c30958d16b4e92f0ad3716c8e45b"), bytes.fromhex("30e0382aab4f7051e1ed5e9406a2fdfd9a372d63b58f1e9a74794dc2538e113d")
RECOVERY, ONCE, INSTALL = bytes.fromhex("4980454f75f0e6f496a6819535e4600007850932b9ccfb4a8a67d7aea1c393c4"), bytes(range(0x21, 0x2D)), "01J8Z9K2M4P6Q8R0T2V4X6Z8B1"


def test_key_hierarchy(spark):
    assert crypto.data_key(MASTER) == DATA
    for version, tag in ((1, "6e14a7cdbf9875b2172533aa7e66abe1"), (2, "ff093aa61eb8a72c7957b9710f3d834a")):
        assert crypto.seal_key_check(spark, DATA, ONCE, INSTALL, version).box.hex() == "6b4356adaab7ca240c3d4bf46d2f" + tag
    block = crypto.seal_key_check(spark, DATA, ONCE, INSTALL)
    crypto.verify_key_check(spark, DATA, block)
    other = crypto.Sealed(ONCE, block.box, crypto.KEY_CHECK_AAD.format(version=1, install_id="01J8ZOTHERDEVICE0000000000X"))
    for key, sealed in ((bytes(b ^ 1 for b in DATA), block), (DATA, other)):
        with pytest.raises(crypto.AuthenticationError):
            crypto.verify_key_check(spark, key, sealed)
    wrapped = crypto.wrap_master_key(spark, RECOVERY, MASTER, ONCE)
    assert wrapped.box.hex() == "6d4e2e65a3d216e971402d39f8a3d6f3850c7e5bfe1c221d7ef948284a2d6d3e" + "460239f232f91b75dd0a1b1d2f2fc210"
    assert crypto.unwrap_master_key(spark, RECOVERY, wrapped) == MASTER
    with pytest.raises(crypto.AuthenticationError):
        crypto.unwrap_master_key(spark, bytes(b ^ 1 for b in RECOVERY), wrapped)


@pytest.mark.parametrize(
    ("parameters", "fits"),
    [((65536, 3, 1, 16, 32), True), ((262144, 4, 4, 16, 32), True), ((19456, 2, 1, 8, 32), True), ((1048576, 16, 8, 64, 32), True), ((19455, 3, 1, 16, 32), False), ((1048577, 3, 1, 16, 32), False), ((65536, 1, 1, 16, 32), False), ((65536, 17, 1, 16, 32), False), ((65536, 3, 0, 16, 32), False), ((65536, 3, 9, 16, 32), False), ((65536, 3, 1, 7, 32), False), ((65536, 3, 1, 65, 32), False), ((65536, 3, 1, 16, 16), False)],
)
def test_password_hash_bounds(parameters, fits):
    assert crypto.password_hash_fits(*parameters) is fits
    kib, passes, lanes, salt, size = parameters
    if not fits:
        with pytest.raises(ValueError):
            crypto.argon2id(b"x", bytes(salt), kib, passes, lanes, size)


def test_empty_passwords_are_refused():
    with pytest.raises(ValueError):
        crypto.argon2id(b"", bytes(16), 65536, 3, 1)


HEADER = "5046424f4f4b0100000100010007010100010000000000030120001000080400000000000f000000000000f0e69e9c84101112131415161718191a1b1c1d1e1fa0a1a2a3a4a5a6a7a0a1a2a3a4a5a6a7000000000001020304050607000100010000000000000000000000000000000000000000000000000000000000000000"


def test_header():
    h = container.Header.decode(bytes.fromhex(HEADER))
    assert (h.flags, h.kib, h.passes, h.lanes, h.chunk_kib, h.plaintext_length, h.chunk_count, h.volume, h.volumes) == (7, 65536, 3, 1, 1024, 251658240, 240, 1, 1)
    assert h.encode().hex() == HEADER
    made = container.Header(bytes(range(0x10, 0x20)), bytes(range(0xA0, 0xA8)), 251658240, 240, 7, volume_set=bytes(range(8)))
    assert made.encode().hex() == HEADER


@pytest.mark.parametrize(
    ("header", "error"),
    [
        (HEADER.replace("4f4f4b0100000100010007", "4f4f4b0100000101010007"), container.BadHeader),
        (HEADER.replace("5046424f", "50464230"), container.NotAContainer),
        ("5046424f4f4b0100000200010007010100010000000000030120001000080400000000000f000000000000f06d4da29d" + HEADER[96:], container.NewerFormat),
        ("5046424f4f4b0100000100010807010100010000000000030120001000080400000000000f000000000000f0058aa8d0" + HEADER[96:], container.BadHeader),
        (HEADER[:200], container.BadHeader),
    ],
)
def test_broken_headers(header, error):
    with pytest.raises(error):
        container.Header.decode(bytes.fromhex(header))


def test_odd_password_hash_parameters():
    for kib, passes, lanes in ((19_455, 2, 1), (65_536, 1, 1), (65_536, 3, 9)):
        with pytest.raises(container.OddParameters):
            container.Header.decode(container.Header(bytes(16), bytes(8), 0, 0, kib=kib, passes=passes, lanes=lanes).encode())
