"""Private keys right after an equals sign or a slash, and armoured ones with escaped line ends."""

import json
import re

import pytest
from .test_decontam_secrets import OPENSSH, PKCS8, RSA, SEC1, b64

from corvina.llm import secret_scan

KEYS = (RSA, PKCS8, SEC1, OPENSSH)


@pytest.mark.parametrize("before", ["PRIVATE_KEY=", "key=", "https://x.org/get?k=", "k==", "https://x.org/keys/", "A_NAME_OF_MORE_THAN_THIRTY_TWO_LETTERS="])
def test_after_a_sign(before):
    for key in KEYS:
        for url in (False, True):
            text = b64(key, url)
            got = secret_scan.confirmed_spans(f"é {before}{text} after")
            assert got == [("key", 2 + len(before), 2 + len(before) + len(text))]
            assert text not in secret_scan.redacted(f"é {before}{text} after", got)
    assert secret_scan.confirmed_spans(before + b64(bytes(range(200)))) == []


@pytest.mark.parametrize("end", ["\\n", "\\r\\n", "\\\\n", "\r\n"])
def test_escaped_line_ends(end):
    for key in KEYS[:3]:
        armour = end.join(["-----BEGIN PRIVATE KEY-----", *re.findall(".{1,64}", b64(key)), "-----END PRIVATE KEY-----"])
        for text in (armour, armour + end, armour.replace("/", "\\/")):
            whole = f'{{"private_key": "{text}"}}'
            assert secret_scan.confirmed_spans(whole) == [("key", 17, 17 + len(text.removesuffix(end)))]
    dumped = json.dumps({"k": "-----BEGIN RSA PRIVATE KEY-----\n" + b64(RSA) + "\n-----END RSA PRIVATE KEY-----\n"})
    assert [k for k, _, _ in secret_scan.confirmed_spans(dumped)] == ["key"]
    assert secret_scan.confirmed_spans(dumped.replace(b64(RSA), b64(RSA[:-3]))) == []


def test_redacted_in_a_table(spark):
    text = f"PRIVATE_KEY={b64(PKCS8)}\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r["text"] for r in secret_scan.redact(docs).collect()] == ["PRIVATE_KEY=[SECRET]\n"]
