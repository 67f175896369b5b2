"""Templated threads: `events` as conversations, the same in Spark and in DuckDB.

Each event is a turn of its user's thread. Its sentence, from the list, is picked by event type and id; the amount and the host
come from the event, so the rules see varied text. The sentences are our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCES = [
    "S: 고객센터입니다. 인증번호 6자리를 알려 주세요",
    "S: 지금 바로 {amount}원을 안전 계좌로 이체해 주세요",
    "R: 네 알겠습니다 확인했어요",
    "S: 앱 설치 후 원격 지원을 시작하겠습니다 anydesk 실행해 주세요",
    "S: 배송지 확인은 http://{host}/track 링크를 눌러 진행하세요",
    "R: 그 번호는 왜 필요한가요",
    "S: 검찰 수사관입니다. 계좌 동결 전에 협조 바랍니다",
    "S: 엄마 나 폰 고장났어 이 번호로 {amount}원 보내줘",
    "S: 오늘 점심 같이 먹을래요",
    "S: 고수익 재택 알바 모집, 텔레그램으로 연락 주세요",
    "R: 입금했어요",
    "S: 상품권 구매 후 핀 번호를 보내 주세요",
    "S: 정부 지원금 대상자 조회는 https://{host}.gov24-help.top/apply 에서 신청",
    "S: 코인 지갑 주소로 USDT 전송 부탁드립니다",
    "S: 가족에게 말하지 마세요. 비밀 유지가 중요합니다",
    "S: 저금리 대출 가능, 수수료 선입금 필요합니다",
    "S: 단축 링크 bit.ly/a{host} 눌러 로그인 인증 부탁드립니다",
    "S: 계정이 잠겨 본인 인증이 필요합니다. 해외 결제 시도가 감지되었습니다",
    "S: QR 코드 스캔하고 간편 결제 진행해 주세요",
    "S: 통장 대여 알바 모집, 수수료 지급합니다",
    "S: ATM 가서 버튼을 눌러 현금 인출 후 퀵으로 전달해 주세요",
    "S: 구독 결제 취소는 고객센터 상담 링크로 문의하세요",
    "S: 세금계산서 확인을 위해 https://{host}/doc 에서 뷰어 설치 해 주세요",
    "S: 카톡 프로필 링크 확인해 주세요",
    "S: 여권 사진과 계좌번호를 먼저 보내 등록해야 출국 가능, 해외 단기 고수익",
    "S: 투자 리딩방 초대, 원금 보장 https://{host}/vip 입장하세요",
    "S: 면접장 주소 안내, 내일 교육장으로 방문 출석 바랍니다",
    "S: 미납 과태료 고지, 기한 내 납부하지 않으면 압류 예정 http://{host}/pay 링크에서 납부하세요",
    "S: 인증번호를 대신 입력해 처리해 드리겠습니다",
    "S: 고객센터로 전화하지 마시고 끊지 마세요. 이 링크에서만 진행됩니다",
    "S: 이름과 주민번호, 신분증 사진을 작성해 제출해 주세요",
    "S: 공식 고객센터 번호로 문의하는 게 제일 안전하다고 추천하더라",
    "S: 사내 공지: 회사 IT 안내는 https://intranet.{host}/notice 에서 확인",
    "R: 신청한 적 없는데요 제가 아닌데 왜 오죠",
    "R: 지금 바로 이체할게요 보내겠습니다",
    "R: 앱 설치할게요 다운받을게요",
    "R: 인증번호 알려드릴게요 입력할게요",
    "R: 은행으로 갈게요",
    "R: 이거 사기 맞나요 확인해 주세요",
    "R: 차단했고 신고했어요",
    "R: 앱 설치했어요 anydesk 연결했습니다",
    "R: 링크 눌렀어요",
    "U: 승인번호를 캡처해서 보내 주세요 지금 즉시",
    "U: 네 확인했어요 전송했습니다 보냈어요",
    "S: [발신 010-1234-5678] 택배 운송장 주소 확인 http://{host}/a.apk 다운로드",
    "S: 카카오뱅크 은행 보안 점검 https://kakaobank-{host}/login 에서 로그인 인증",
    "S: hxxp://{host}/x 또는 example[.]com/y 접속, [kbstar.com](https://{host}/z) 클릭",
    "S: 배송 https://{host}/go?url=https%3A%2F%2Fkbstar.com%2Flogin 확인",
]
_N = len(SENTENCES)


def threads(events: DataFrame, *more: Column) -> DataFrame:
    """turns(thread_id, ix, role, text): a thread for each user and block of 4096 event ids, which bounds a hot user's threads; and `more` columns of the events."""
    pick = (F.col("event_id") + F.length("event_type")) % _N
    amount = (F.abs(F.floor(F.col("value") * 100)).cast("long") % 900 + 100) * 1000
    text = F.get(F.array(*(F.lit(s) for s in SENTENCES)), pick.cast("int"))
    text = F.replace(F.replace(text, F.lit("{amount}"), amount.cast("string")), F.lit("{host}"), F.concat(F.lit("h"), (F.col("event_id") % 97).cast("string"), F.lit(".example.shop")))
    thread = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 4096).cast("long").cast("string"))
    return events.select(thread.alias("thread_id"), F.col("event_id").alias("ix"), F.substring(text, 1, 1).alias("role"), F.substring(text, 4, 1000).alias("text"), *more)


def threads_sql() -> str:
    """The same as a DuckDB SELECT."""
    rows = ", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES)
    return f"""
SELECT concat_ws('-', user_id::VARCHAR, floor(event_id / 4096.0)::BIGINT::VARCHAR) AS thread_id, event_id AS ix,
       substr(t, 1, 1) AS role, substr(t, 4, 1000) AS text
FROM (SELECT user_id, event_id, replace(replace(([{rows}])[((event_id + length(event_type)) % {_N})::INT + 1],
        '{{amount}}', ((abs(floor(value * 100))::BIGINT % 900 + 100) * 1000)::VARCHAR), '{{host}}', 'h' || (event_id % 97)::VARCHAR || '.example.shop') AS t
      FROM events)
"""
