"""Compressed layers of several members, and of more bytes than are held at a time."""

from __future__ import annotations

import base64
import gzip
import zlib

from ledgerlens.llm import secrets

SECRET = "password=hunter2hunter2"


def spans(data: bytes):
    run = base64.b64encode(data).decode()
    base, every = secrets.all_spans(f"see {run} end")
    assert every == [] or every == [(4, 0, 4 + len(run))] or every == [(4, k, 4 + len(run)) for k in (0, 2)]
    return every


def test_all_members_are_read():
    quiet, loud = b"nothing to see here\n", SECRET.encode()
    for pack in (gzip.compress, zlib.compress):
        assert spans(pack(quiet) + pack(loud))
        assert spans(pack(quiet) + b"\0" * 5 + pack(loud))
        assert spans(pack(quiet) + pack(loud[:9]) + pack(loud[9:]))
        assert spans(pack(pack(quiet) + pack(loud)))
        assert spans(pack(loud) + pack(quiet)[:-3])  # a broken member does not hide a whole one
        assert spans(pack(loud) + b"junk") and not spans(pack(loud)[:-3]) and not spans(pack(quiet))


def test_large_layers_are_read():
    for n in (secrets.PIECE, 1 << 24):
        pad = b"nothing, to, see, here\n" * (n // 23)
        assert spans(gzip.compress(pad + SECRET.encode()))
        assert spans(gzip.compress(pad) + gzip.compress(SECRET.encode()))
        assert not spans(gzip.compress(pad)) and spans(gzip.compress(pad + SECRET.encode() + b"\0"))  # a control character hides nothing


def test_matches_are_not_cut(monkeypatch):
    inner = base64.b64encode(SECRET.encode() + b" " * 40).decode()
    lines = f"a, b; token = 'abcdefgh' {'f' * 30}\n{inner} é x\n" * 3
    data = zlib.compress(lines.encode())
    want = secrets.all_spans(base64.b64encode(data).decode())
    assert {kind for _, kind, _ in want[1]} == {0, 2}
    for piece in range(1, 60):
        monkeypatch.setattr(secrets, "PIECE", piece)
        assert secrets.all_spans(base64.b64encode(data).decode()) == want
        source = lambda: secrets._whole_members(lambda: iter((data,)), 1)
        got = list(secrets._pieces(source))
        assert "".join(got) == lines and all(secrets._BREAK.match(x[-1]) for x in got[:-1])
