"""Recordings built byte by byte, with what is true of them."""

import random
import struct

HEADER = struct.Struct("<IBBHIIII")
MAGIC, VIDEO, AUDIO = 0x31504143, 0x83, 0x84


def record(kind, endpoint=0, index=0, seq=0, status=0, requested=0, actual=0, payload=b""):
    return HEADER.pack(MAGIC, kind, endpoint, index, seq, status, requested, actual) + payload


def data(endpoint, index, seq, payload, requested=None, status=0):
    return record(0, endpoint, index, seq, status, len(payload) if requested is None else requested, len(payload), payload)


def transport(transfers=4, per=8, size=64, short_every=0, loss_at=None, error_at=None, seed=1):
    """A two-endpoint recording and its truth: bytes and packets by endpoint."""
    rng, out, truth = random.Random(seed), [record(3, actual=5, payload=b"hello")], {VIDEO: [0, 0], AUDIO: [0, 0]}
    n = 0
    for t in range(transfers):
        for endpoint in (VIDEO, AUDIO):
            if endpoint == VIDEO and t == loss_at:
                out.append(record(1, VIDEO, 0, t, 0, 3, 3 * size))
            if endpoint == VIDEO and t == error_at:
                out.append(record(2, VIDEO, 0xFFFF, t, 5))
            for i in range(per):
                n += 1
                length = size - 16 if short_every and n % short_every == 0 else size
                out.append(data(endpoint, i, t, rng.randbytes(length), size))
                truth[endpoint][0] += length
                truth[endpoint][1] += 1
        out.append(record(4, status=t * 1000))
    return b"".join(out), truth


UNIT = 756_048


def unit(counter, size=UNIT, fmt=0xE801):
    head = b"\x00\x00\xff\xff" + struct.pack("<HH", counter, fmt) + bytes(40)
    return (head + b"\x80\x10" * ((size - 47) // 2))[:size]


def resync(counter):
    return b"DeckLinkAudioResyncT" + struct.pack("<H", counter) + b"\x65\x6e"


def pcm(n, rng):
    return b"".join(rng.randbytes(6) + bytes(18) for _ in range(n))


def adversarial(seed=0x55504A31):
    """Junk before the first marker, a short unit, a unit damaged by loss and a skipped transfer, a cut end; audio with holes and junk."""
    rng, out, seq = random.Random(seed), [], {VIDEO: 0, AUDIO: 0}

    def send(endpoint, blob, first=None):
        at = 0
        while at < len(blob):
            n = first if first else rng.randrange(37, 4093)
            first = None
            out.append(data(endpoint, 0, seq[endpoint], blob[at : at + n]))
            seq[endpoint] += 1
            at += n

    send(VIDEO, b"XYZ" + unit(65534), first=5)
    send(AUDIO, b"abcde" + resync(65535) + pcm(17, rng) + resync(0) + pcm(19, rng))
    send(VIDEO, unit(65535, UNIT - 224))
    body = unit(0)
    send(VIDEO, body[: UNIT // 2])
    out.append(record(1, VIDEO, 0, seq[VIDEO], 0, 1, 4096))
    seq[VIDEO] += 1
    send(VIDEO, body[UNIT // 2 :])
    out.append(record(1, AUDIO, 0, seq[AUDIO], 0, 1, 192))
    send(AUDIO, b"junk" + resync(1) + pcm(1, rng))
    send(VIDEO, unit(1))
    send(VIDEO, unit(2)[:100])
    return b"".join(out)


def plain(units=6, seed=3):
    """Whole units in 15,360-byte packets, one resync for each and 1601 or 1602 samples."""
    rng, out, video, audio = random.Random(seed), [], 0, 0
    for c in range(units):
        blob = resync(c) + pcm(1602 if c % 5 in (0, 2) else 1601, rng)
        for at in range(0, len(blob), 4000):
            out.append(data(AUDIO, 0, audio, blob[at : at + 4000]))
            audio += 1
        blob = unit(c)
        for at in range(0, len(blob), 15_360):
            out.append(data(VIDEO, 0, video, blob[at : at + 15_360]))
            video += 1
    return b"".join(out)
