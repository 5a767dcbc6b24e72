import pytest

from quarry.llm import sentences as S

CASES = [
    "Title line\n\n|Mr. Sudi saw it, cf. the plan. |It is 88.5 kg (approx. 3 m)... then it ended. |Why? |After No. 10 came Fig. 7 of Misox Inc. in version 4.7.9. |Our team left at 5 p.m. |It was audited by Gudalan Ltd. |“Is it done?” |They asked, “Is it done?” |“It is not done yet.” said the office. |It was recorded with PLC-9194. |5G is on.",
    "예산 대장\n\n|연동 대책은 못하였다. |2031.01.06. 기준으로 통보한다. |5. 2.(수) 기준으로 배정해야 한다.|2033. 12. 24. 기준으로 이관한다. |지표는… 사양을 배정하고 있다! |정상이다(전략 제외, H2O 등 포함.). |세부는 Vol. 31 및 2.8절을 따른다. |초안_v2.6.xlsx 파일을 통보해야 한다. |누랩 측은 “아직 아니다.”라고 밝혔다. |‘필요한가?’라는 질의를 받았다.|다음 문장이다.",
    "検査は８.２%となり、Ｎｏ.３７を移管する。|契約（資料を除く。）は調整する。|担当者は「変更されていない。」と述べた。|品質…納期を配布した！|いつですか？\n\n|- 部品を確認\n|- 装置を確認",
    "负责人说：“还没有验证。”|在合同之后，分析了课题。|“为什么没有验证？”的问题由车间组引进。|项目（不含课题）……负责讨论！|达到31.6%，参见No.65的库存。|何时可以变更？|“检查没有更新。”|“检查为什么没有？”的问题由组更新。",
    "Am 14. Juli wurde sie geändert. |Nach Nr. 28 Abs. 1 gilt ca. 51,7 % für die Abweichung. |„Sie ist nicht bestätigt.“, schrieb die Tozinin GmbH. |Die Messung (z. B. HMI-6680) und die d. h. die andere in Ver. 5.9 wurden bzw. werden geändert. |„Die Freigabe ist da.“ |Warum?",
    "เอกสารแนบ\n\n|คณะทำงานอนุมัติงบประมาณในภายหลัง |ฝ่ายผลิตส่งมอบชิ้นส่วน 256 รายการตามกำหนด |ผู้รับจ้างส่งมอบ AI-2755 แล้ว",
    "Wrapped line goes\non here. |Next one.\n\n\n|Alone\r\n\r\n|• item one\n|• item two",
    "\u0405\u0435\u0435 N\u043e. 5 for \u0456t. |N\u200bo. 6 is h\u0435re.",
]


@pytest.mark.parametrize("case", CASES)
def test_units(case):
    parts = case.split("|")
    text, want, at = "".join(parts), [], 0
    for p in parts:
        want.append(at)
        at += len(p)
    got = S.starts(text)
    assert [text[a : a + 25] for a in got] == [text[a : a + 25] for a in want]


def test_offsets_with_invisible_characters():
    text = "\ufeffOne i\u200bs.\u00a0\nTwo."
    assert [text[p] for p in S.starts(text)] == ["O", "T"]


@pytest.mark.parametrize("gap", [1, 2, 31, 32, 33, 500])
@pytest.mark.parametrize("blank", [" ", "\t"])
def test_wide_gaps(gap, blank):
    assert S.starts("The first one ends here." + " " + blank * (gap - 1) + "The second one follows.") == [0, 24 + gap]
    assert S.starts("The first one ends here.\n" + blank * gap + "The second one follows.") == [0, 25 + gap]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "No end"), (5, "A. " * 1), (6, "x. Y" * 3000), (6, "One. Two.")]
    got = S.sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {4, 5, 6}
    assert S.sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_which_documents(spark):
    rows = [(1, "ok", " TXT"), (2, "failed", "txt"), (3, "ok", "pdf"), (4, None, "txt"), (5, "ok", None)]
    assert [r.doc_id for r in S.plain_documents(spark.createDataFrame(rows, "doc_id long, status string, format string")).collect()] == [1]
