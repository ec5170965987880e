"""Texts in Latin-script languages that the model hasn't learned are rejected, labelled ones stay."""

import pytest

from tidemill.llm import langid
from tidemill.llm.queries import remainder

UNLEARNED = {
    "it": "Il governo ha annunciato ieri una nuova legge per la protezione delle foreste e dei laghi di montagna, che sarà discussa in parlamento.",
    "fi": "Hallitus ilmoitti eilen uudesta laista metsien ja järvien suojelemiseksi, ja siitä keskustellaan eduskunnassa ensi viikolla.",
    "pl": "Rząd ogłosił wczoraj nową ustawę o ochronie lasów i jezior górskich, która będzie omawiana w parlamencie w przyszłym tygodniu.",
    "tr": "Hükümet dün ormanların ve göllerin korunması için yeni bir yasa açıkladı ve bu yasa gelecek hafta mecliste görüşülecek.",
    "sw": "Serikali ilitangaza jana sheria mpya ya kulinda misitu na maziwa ya milimani, ambayo itajadiliwa bungeni wiki ijayo.",
    "vi": "Chính phủ hôm qua đã công bố một luật mới để bảo vệ rừng và hồ trên núi, luật này sẽ được thảo luận tại quốc hội vào tuần tới.",
}


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_unlearned_latin_languages_go_and_labelled_texts_stay(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    model = langid.train(docs, remainder(4) != 2)
    texts = list(UNLEARNED.values())
    for n in (1, 6):
        _, _, rejected = model.predict([" ".join([t] * n) for t in texts])
        assert rejected.all(), dict(zip(UNLEARNED, rejected.tolist(), strict=True))
    held = docs.where("lang is not null").where(remainder(4) == 2)
    assert langid.keep(held, model).count() == held.count()
