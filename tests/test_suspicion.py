import random

from pagewright.sources.layout import parse_columns
from pagewright.sources.pagewriter import make_pages
from pagewright.sources.suspicion import page_marks, suspected


def test_cipher_pages(spark, tmp_path):
    rng = random.Random(12345)
    plain = list(make_pages(parse_columns("id int4, v text"), (((i, "x" * 50), {}) for i in range(500))))
    (tmp_path / "1").write_bytes(b"".join(plain) + bytes(8192))
    (tmp_path / "2").write_bytes(b"".join(p[:64] + rng.randbytes(8192 - 64) for p in plain))
    good = suspected(page_marks(spark, str(tmp_path / "1"))).first()
    assert not good.suspected_cipher and good.n_zero == 1 and good.n_good == len(plain) and good.scan_mode == "standard"
    bad = suspected(page_marks(spark, str(tmp_path / "2"))).first()
    assert bad.suspected_cipher and bad.n_cipher == len(plain)
