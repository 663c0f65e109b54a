"""Look-alike letters as Unicode lists them.

The table is read from where every Spark installation has it: the data of ICU's spoof
checker in Spark's own `icu4j` jar, which is Unicode's confusables.txt in binary form
(a header, the characters in order, their prototypes or places in a string pool).
"""

from __future__ import annotations

import glob
import os
import struct
import unicodedata
import warnings
import zipfile

import pyspark

MEMBER = "com/ibm/icu/impl/data/icudata/confusables.cfu"
MAGIC = 0x3845FDEF


def jar() -> str | None:
    """Path of the icu4j jar of this Spark installation."""
    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    return next((f for h in homes if h for f in sorted(glob.glob(os.path.join(h, "jars", "icu4j-*.jar")))), None)


def parse(data: bytes) -> dict[str, str]:
    """Character to prototype."""
    order = ">" if data[8] else "<"
    (start,) = struct.unpack_from(order + "H", data, 0)
    magic, _, _, keys, n_keys, values, n_values, pool, n_pool = struct.unpack_from(order + "i4s7i", data, start)
    if magic & 0xFFFFFFFF != MAGIC:
        raise ValueError("not a table of confusables")
    ks = struct.unpack_from(f"{order}{n_keys}I", data, start + keys)
    vs = struct.unpack_from(f"{order}{n_values}H", data, start + values)
    units = data[start + pool : start + pool + 2 * n_pool].decode("utf-16-be" if order == ">" else "utf-16-le", "surrogatepass")
    # Places in the pool are counted in UTF-16 units.
    raw = units.encode("utf-16-be", "surrogatepass")
    out = {}
    for k, v in zip(ks, vs, strict=True):
        size = (k >> 24) + 1
        out[chr(k & 0xFFFFFF)] = chr(v) if size == 1 else raw[2 * v : 2 * (v + size)].decode("utf-16-be", "surrogatepass")
    return out


def prototypes() -> dict[str, str]:
    """Prototype of each character that Unicode lists; empty, with a warning, without the jar."""
    path = jar()
    if path is None:
        warnings.warn("no icu4j jar found: only the built-in look-alikes are known", stacklevel=2)
        return {}
    with zipfile.ZipFile(path) as z:
        return parse(z.read(MEMBER))


def small_capitals() -> dict[str, str]:
    """Small capitals, by their names, as the letters they are read as."""
    out = {}
    for i in (*range(0x0250, 0x02B0), *range(0x1D00, 0x1DC0), *range(0xA720, 0xA800)):
        name = unicodedata.name(chr(i), "")
        last = name.removeprefix("LATIN LETTER SMALL CAPITAL ")
        if len(last) == 1 and last != name:
            out[chr(i)] = last.lower()
    return out
