from pathlib import Path

import pytest
from test_licenses import scan

SHARED = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not SHARED.is_dir(), reason="the published texts aren't at hand")
def test_published_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    texts = [(SHARED / f).read_text() for f in files.values()]
    assert [x[0] for x in scan(spark, texts)] == list(files)
    assert [x[0] for x in scan(spark, [texts[0].split("APPENDIX:")[0].upper(), texts[0][:-200], texts[3] + " or so"])] == ["Apache-2.0", None, None]
