"""Keys and tokens in the surroundings in which they are found, and the time they take."""

import json
import time

import pytest

from quarrylens.llm import secret_scan
from tests.llm.test_secret_scan import RSA, SSH, b64, der, kinds, token


def keys():
    for extra in range(3):
        yield der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, bytes(range(7, 55 + extra))))
    yield RSA
    yield SSH


def lines(text, width=64):
    return [text[i : i + width] for i in range(0, len(text), width)]


def bare(key):
    return b64(key).rstrip("=")


SURROUNDINGS = {
    "inside a path": lambda k: f"see key/{b64(k)} here",
    "after an underscore": lambda k: f"a_{b64(k)}",
    "after a plus": lambda k: f"x+{b64(k)}\nnext",
    "after two letters": lambda k: f"ab{b64(k)}",
    "before a dash": lambda k: f"{bare(k)}-xyz",
    "before a letter": lambda k: f"{bare(k)}z and on",
    "indented": lambda k: "key:\n  " + "\n  ".join(lines(b64(k))) + "\nend",
    "quoted": lambda k: "> " + "\n> ".join(lines(b64(k))) + "\n> end",
    "quoted twice": lambda k: ">> " + "\r\n>> ".join(lines(b64(k))),
    "blank lines": lambda k: "\n\n".join(lines(b64(k))) + "\n\nThe end",
    "carriage returns": lambda k: "\r".join(lines(b64(k))) + "\rThe end",
    "narrow lines": lambda k: "\n".join(lines(b64(k), 20)),
    "in JSON": lambda k: json.dumps({"private_key": "\n".join(lines(b64(k)))}),
    "PEM in JSON": lambda k: json.dumps({"private_key": "-----BEGIN PRIVATE KEY-----\n" + "\n".join(lines(b64(k))) + "\n-----END PRIVATE KEY-----\n"}),
    "quoted PEM": lambda k: "> -----BEGIN PRIVATE KEY-----\n> " + "\n> ".join(lines(b64(k))) + "\n> -----END PRIVATE KEY-----",
    "wrapped hex": lambda k: "\n".join(lines(k.hex())),
    "hex with colons": lambda k: ":".join(lines(k.hex(), 2)),
    "hex with colons, wrapped": lambda k: "    " + ":\n    ".join(":".join(lines(x, 2)) for x in lines(k.hex(), 30)),
    "hex after a hex letter": lambda k: "a" + k.hex(),
    "hex with its mark": lambda k: "0x" + k.hex().upper() + " ",
}


@pytest.mark.parametrize("name", SURROUNDINGS)
def test_keys_are_found_whole(name):
    for key in keys():
        text = SURROUNDINGS[name](key)
        found = [text[a:b] for a, kind, b in secret_scan.confirmed_spans(text) if kind == 3]
        assert len(found) == 1, (name, len(key))
        clean = found[0]
        for mark in ("\\r", "\\n", "\r", "\n", ">", " "):
            clean = clean.replace(mark, "")
        if "BEGIN" in clean:
            assert clean.startswith("-----BEGIN") and clean.endswith("KEY-----")
        elif "hex" in name:
            assert clean.replace(":", "").lower() == key.hex()
        else:
            assert clean.rstrip("=") == bare(key)


def test_tokens_beside_other_signs():
    for alg, size in (("HS256", 32), ("ES256", 64), ("RS256", 256)):
        own = token(alg, size)
        for text in (f"a.{own}", f"x-{own}", f"x_{own} ", f"{own}_x", f"{own}-x", f"{own}.", f"v1.2.{own}.json", f"Bearer {own},"):
            assert [text[a:b] for a, kind, b in secret_scan.confirmed_spans(text) if kind == 4] == [own], text
    two = f"{token('HS256', 32)} {token('HS512', 64)}"
    assert kinds(two) == ["signed", "signed"]


def test_parts_of_keys_and_other_structures_are_none():
    for key in keys():
        for text in (b64(key)[4:], b64(key)[:-8], key[1:].hex(), b64(b"\x30\x83" + key[2:])):
            assert "key" not in kinds(text)
    certificate = der(0x30, der(0x30, der(2, b"\1" * 9) + der(0x30, der(6, b"\x2a\x86"))) + der(0x30, der(6, b"\x2a\x86")) + der(3, b"\0" * 129))
    public = der(0x30, der(2, b"\1" * 129) + der(2, b"\1\0\1"))
    assert "key" not in kinds(b64(certificate)) + kinds(b64(public)) + kinds(certificate.hex())


@pytest.mark.parametrize("line", ["MIIB" + "A" * 60, "MIIEowIBAAKCAQEA" + "q" * 48, "308201" + "0a" * 29, "-eyJhbGciOiJ" * 5 + ".eyJh.", "MHcCAQEEI" + "MHcCAQEEI" * 6, "-----BEGIN PRIVATE KEY-----", "eyJhIjoiMSJ9." * 5])
def test_ten_megabytes_take_seconds(line):
    for text in ("\n".join([line] * (10_000_000 // (len(line) + 1))), line * (10_000_000 // len(line))):
        begun = time.process_time()
        secret_scan.confirmed_spans(text)
        assert time.process_time() - begun < 40
