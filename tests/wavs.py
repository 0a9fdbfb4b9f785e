"""Small WAV files made by hand."""

import struct

import numpy as np


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def fmt(rate, channels=1, bits=16, kind=1, extra=b""):
    block = channels * bits // 8
    return chunk(b"fmt ", struct.pack("<HHIIHH", kind, channels, rate, rate * block & 0xFFFFFFFF, block, bits) + extra)


def riff(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav(samples, rate, channels=1, bits=16, kind=1, before=b""):
    return riff(fmt(rate, channels, bits, kind), before, chunk(b"data", samples.tobytes()))


def sine(seconds, rate, hertz=500.0, level=0.5):
    t = np.arange(int(round(seconds * rate))) / rate
    return level * np.sin(2 * np.pi * hertz * t)


def int16(signal):
    return (signal * 32767).astype("<i2")
