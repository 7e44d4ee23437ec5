"""Gzip members: ends found exactly, and work in proportion to the file."""

import gzip
import random
import time

from assayloom.llm import warc


def record(i, body):
    return (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def test_members_of_all_sizes_and_a_damaged_one():
    draw = random.Random(2)
    bodies = [draw.randbytes(n) for n in (0, 1, 4000, 70_000, 300_000, 12)] + [b"a" * 1_000_000]
    bodies.insert(3, bytes(draw.choice(b"abcdefgh ") for _ in range(9000)))  # its record line is not stored in the clear
    members = [gzip.compress(record(i, b)) for i, b in enumerate(bodies)]
    data = b"".join(members)
    found = list(warc.salvage(data))
    assert [(k, b) for k, _, _, _, b in found] == [("record", b) for b in bodies]
    assert [f[2] - f[1] for f in found] == [len(m) for m in members] and found[-1][2] == len(data)
    broken = bytearray(data)
    at = len(members[0]) + len(members[1]) + len(members[2]) + 2000
    broken[at:at + 40] = b"\0" * 40
    kinds = [f[0] for f in warc.salvage(bytes(broken))]
    assert kinds.count("record") == len(bodies) - 1 and kinds.count("gap") == 1
    assert [f[0] for f in warc.salvage(data[:-5])].count("record") == len(bodies) - 1


def test_time_grows_with_the_members():
    member = gzip.compress(record(1, random.Random(1).randbytes(1500)))

    def seconds(n):
        start = time.perf_counter()
        assert sum(1 for _ in warc.salvage(member * n)) == n
        return time.perf_counter() - start

    small = min(seconds(3000) for _ in range(3))
    assert seconds(24_000) < 16 * small  # eight times the members; the square would be 64 times
