"""The rule catalogue: fixed identifiers, labels, stages, weights and patterns, as data.

Rows are (id, label, stage, weight, patterns). Patterns are case-insensitive and written with ASCII word boundaries. FIRST_ONLY
patterns yield their first match only, the others all.
"""

from __future__ import annotations

STAGES = ("info", "verify", "install", "payment")
LINK_PATTERN = r"https?://(?!drive\.google\.com\b)(?!docs\.google\.com\b)(?!github\.com\b)(?![^/\s)]*intranet\b)[^\s)]+"
FIRST_ONLY = {r"(bit\.ly|t\.co|tinyurl\.com|goo\.gl|me2\.do|han\.gl|url\.kr|vo\.la)"}
CALL_WEIGHTS = {"call_otp": 30, "call_remote": 35, "call_urgent": 15, "call_first_contact": 10}
MEDIUM, HIGH = 35, 65

#: Fixed values, in the order in which rules are tried.
RULES = [
    ("link", "URL 포함", "verify", 25, [LINK_PATTERN]),
    ("shortener", "단축 URL", "verify", 30, [r"(bit\.ly|t\.co|tinyurl|me2\.do|han\.gl)"]),
    ("apk", "APK/설치파일 유도", "install", 28, [r"(\.apk\b|\bapk\b|프로파일\s*설치|뷰어\s*설치|다운로드|다운\s*받)"]),
    ("ctx_pay_with_link", "결제/승인/알림 + 확인 링크(검증 단계)", "verify", 14, [
        r"(결제|이체|송금|승인|카드).{0,24}(알림|설정|확인|차단|해제|보안|보호).{0,40}https?://",
        r"(알림\s*설정|설정\s*확인|확인\s*링크|차단\s*처리).{0,40}https?://",
    ]),
    ("ctx_transfer_phrase", "금액/송금/입금 직접 요구(보내줘/부쳐줘/충전)", "payment", 18, [
        r"(\d[\d,]{1,}\s*(만\s*)?원).{0,20}(보내|보내줘|부쳐|부쳐줘|송금|이체|입금|납부)",
        r"(보내|부쳐|송금|이체|입금|납부).{0,20}(\d[\d,]{1,}\s*(만\s*)?원)",
        r"(입금|충전).{0,20}(만\s*하면|하면\s*시작|후\s*시작|하면\s*됩니다|하면\s*돼)",
    ]),
    ("otp", "인증번호/OTP/승인번호(언급/요구)", "verify", 22, [
        r"(otp|오티피|인증\s*번호|인증번호|인증\s*코드|인증코드|보안\s*코드|보안코드|확인\s*코드|확인코드|ars|2\s*단계\s*인증|승인\s*번호|승인번호|6\s*자리|6자리)",
        r"(인증번호|otp|오티피|승인번호|보안\s*코드|보안코드|확인\s*코드|확인코드|6\s*자리|6자리).{0,24}(불러|읽어|말해|알려|전달|보내|입력|캡처|대신\s*입력|대리\s*입력)",
        r"(불러|읽어|말해|알려|전달|보내|입력|캡처|대신\s*입력|대리\s*입력).{0,24}(인증번호|otp|오티피|승인번호|보안\s*코드|보안코드|확인\s*코드|확인코드|6\s*자리|6자리)",
    ]),
    ("remote", "원격/원격앱/화면공유 유도", "install", 28, [
        r"(원격\s*지원|원격지원|원격\s*제어|원격|화면\s*공유|화면공유|접속\s*코드|접속코드|원격\s*접속|원격\s*연결)",
        r"(팀뷰어|teamviewer|anydesk|애니데스크|퀵서포트|quicksupport)",
    ]),
    ("apk", "APK/파일 설치 유도", "install", 28, [r"(apk|\.apk|안드로이드\s*패키지|설치\s*파일)"]),
    ("install_app", "앱/뷰어 설치·다운로드 유도", "install", 28, [
        r"""(앱\s*설치|앱[’"'”]?\s*설치|전용\s*앱|보안\s*앱|보안앱|뷰어\s*설치|프로그램\s*설치|설치\s*후|설치가\s*필요|다운로드|다운\s*받|받아\s*서|업데이트|업뎃|권한\s*허용|접근성\s*권한|관리자\s*권한)""",
        r"(스토어|플레이\s*스토어|구글\s*플레이|앱스토어|설치\s*링크)",
        r"(초대\s*코드|초대코드)",
    ]),
    ("link", "링크/주소/URL 문구(실URL 없이도 접속 유도)", "verify", 6, [
        r"((링크|url|주소|사이트|페이지).*(눌러|클릭|접속|확인|로그인|인증|진행|신청|조회))",
        r"((눌러|클릭|접속|확인|로그인|인증|진행|신청|조회).*(링크|url|주소|사이트|페이지))",
        r"(링크|url|주소)\s*(확인|접속|클릭|눌러)",
    ]),
    ("shortener", "단축 URL/단축링크 언급", "verify", 6, [
        r"(bit\.ly|t\.co|tinyurl\.com|goo\.gl|me2\.do|han\.gl|url\.kr|vo\.la)",
        r"(단축\s*링크|단축\s*url|짧은\s*링크)",
    ]),
    ("invest_lure", "투자/리딩방/정보방 유도", "verify", 10, [
        r"(투자|리딩방|정보\s*방|정보방|단톡|단체\s*방|채팅\s*방|채팅방|수익\s*인증|자동\s*투자|고수익|원금\s*보장|보장\s*수익|VIP|초대|초대장)",
    ]),
    ("job_lure", "고액알바/해외 단기 고수익 제안", "verify", 20, [
        r"(고액\s*알바|재택\s*알바|단기\s*고수익|고수익\s*알바|초보\s*가능|당일\s*지급|고정\s*수입|해외\s*(현지|프로젝트|업무)|출국\s*가능|숙식\s*제공|항공권\s*지원|구인|모집|채용|프로젝트\s*인력|인력\s*모집|면접|교육장)",
        r"(월\s*\d{2,}|하루\s*\d{1,3}\s*만).*(가능|이상|지급)",
    ]),
    ("transfer", "송금/이체/입금/선입금/수수료 요구", "payment", 18, [
        r"((송금|이체|입금|납부|결제|정산|충전)\s*(해|해줘|해주|해주세요|해\s*줘|해\s*주|부탁|진행|요청))",
        r"(이체|송금|입금|납부|결제|정산|충전).*(하세요|해\s*주세요|해주셔야|해\s*주셔야|하십시오|바랍니다|부탁드립니다|진행\s*하세요|처리\s*하세요)",
        r"(납부|입금|송금|이체|결제)\s*(하|해)\s*(세요|십시오)",
        r"(선\s*입금|선입금|수수료|보험료|보증\s*보험료|보증보험료|합의금|보증금|위약금|예치\s*금|예치금|등록\s*비|등록비)",
        r"(\d[\d,]{1,}\s*(만\s*)?원).*(보내|보내줘|부쳐|부쳐줘|송금|이체|입금|납부|결제)",
        r"(보내|부쳐|송금|이체|입금|납부|결제).*(\d[\d,]{1,}\s*(만\s*)?원)",
        r"(입금|충전)\s*하면",
        r"(입금|충전).*(하면\s*시작|후\s*시작|하면\s*됩니다|하면\s*돼|완료\s*됩니다|처리\s*됩니다)",
        r"(돈|금액|수수료|선입금|보험료|합의금|보증금|예치금|등록비).*(보내|부쳐|이체|송금|입금|납부|결제)",
    ]),
    ("account_verify", "계정/본인/계좌 인증·확인 유도", "verify", 10, [
        r"(계좌).*(인증|확인|검증|점검|조회)",
        r"(본인).*(인증|확인|검증|점검)",
        r"(계정|아이디|id|로그인).*(인증|확인|검증|점검|복구|해제)",
        r"(비정상|이상).*(접속|로그인|시도|탐지|감지)",
        r"(계정).*(잠김|잠겼|잠겨|잠금|정지|차단|제한)",
        r"(복구|해제|차단\s*해제|정지\s*해제).*(진행|필요|요청)",
    ]),
    ("txn_alert", "결제/이체 ‘시도·탐지’ 알림", "verify", 14, [
        r"(해외\s*결제|해외결제|결제|이체|송금|승인)\s*(시도|탐지|감지|알림)",
        r"(승인|결제|이체|송금).*(대기|대기중)",
        r"(차단\s*대기|차단\s*대기중)",
        r"비정상\s*(결제|이체|송금|승인)",
    ]),
    ("safe_account", "안전계좌/보호계좌 유도", "payment", 22, [r"(안전\s*계좌|안전계좌|보호\s*계좌|보호계좌|임시\s*계좌|임시계좌)"]),
    ("social", "쿠폰/기프티콘/이벤트/상품권 훅", "verify", 10, [r"(기프티콘|상품권|쿠폰|경품|프로모션|이벤트|당첨|선물|핀번호|핀\s*번호|코드)"]),
    ("messenger_phishing", "메신저/프로필 확인 유도", "verify", 2, [
        r"(카카오톡|카톡|텔레그램|라인|디스코드|인스타(?:그램)?|DM|디엠|쪽지)\s*(프로필|채널|오픈\s*채팅|오픈채팅|대화방|채팅방)",
        r"(프로필|채널|오픈\s*채팅|오픈채팅|대화방|채팅방).*(확인|들어가|접속|입장|참여|눌러|클릭)",
        r"(프로필).*(링크|url|주소)",
    ]),
    ("government_benefit", "지원금/환급/대상자 미끼", "verify", 1, [
        r"(지원금|환급금?|보조금|장려금|정부\s*지원|추가\s*지급|미수령)",
        r"(재난\s*지원금|재난지원금|근로\s*장려금|근로장려금|자녀\s*장려금|소상공인\s*지원|소상공인지원|고용\s*보험|고용보험|실업\s*급여|실업급여)",
        r"(대상자).*(조회|확인)",
        r"(조회|확인).*(대상자)",
        r"(정부24|gov\s*24|gov24)",
    ]),
    ("ctx_visit_place", "방문/출석/내방/장소 이동 유도", "verify", 5, [
        r"(방문|내방|출석|출두|오세요|오셔|와\s*주|와줘|이동|도착|집결)",
        r"(오시는\s*길|주소|위치|지도|길\s*안내)",
        r"(면접장|교육장|사무실|지점|센터|창구|역앞|카페|공항|터미널)",
    ]),
    ("go_bank_atm", "ATM/은행 방문·조작 지시", "payment", 18, [
        r"(atm|현금\s*인출|인출|출금|현금화|은행\s*가서|지점\s*가서|창구\s*가서|기기).{0,32}(가서|가\s*서|가\s*신\s*후|가신\s*후|눌러|누르|선택|입력|조작|진행|처리|뽑아|인출\s*해)",
        r"(가서|가\s*서|가신\s*후|가\s*신\s*후).{0,24}(atm|현금\s*인출|출금|인출|은행|지점|기기)",
    ]),
    ("urgent", "긴급/즉시/압박(통화 유지 포함)", "info", 10, [
        r"(긴급|즉시|지금|바로|당장|오늘|오늘까지|곧|빨리|서둘러|급하게|중요|마감)",
        r"(통화).*(끊지\s*마|끊지마|유지)",
        r"(지금).*(가능|처리|진행)",
    ]),
    ("ctx_secrecy", "비밀유지/검색·상담 차단/캡처·녹음 금지", "info", 6, [
        r"(고객센터|공식\s*고객센터|은행\s*고객센터|카드사\s*고객센터|경찰\s*112|112|금감원|국번\s*없이\s*1332).{0,24}(전화|연락|문의).{0,10}(하지\s*마|하지마|하지\s*말|말라|금지)",
        r"(검색|인터넷|포털|네이버|구글|검색창).{0,24}(하지\s*마|하지마|하지\s*말|말라|금지)",
        r"(가족|지인|주변|회사|동료).{0,24}(알리|말하|공유|상담).{0,10}(지\s*마|지마|지\s*말|말라|금지)",
        r"(비밀|대외비|외부\s*공유\s*금지|절대\s*공유\s*금지|혼자만|본인만|단독으로)",
        r"(캡처|스크린\s*샷|스크린샷|사진|촬영|녹음).{0,16}(하지\s*마|하지마|하지\s*말|말라|금지)",
    ]),
    ("authority", "기관/담당자 사칭(권위)", "info", 10, [
        r"(검찰|검찰청|지검|검사|경찰|경찰청|수사관|형사|사이버\s*수사)",
        r"(금감원|금융감독원|금융보안원|FIU|금융정보분석원|예금보험공사)",
        r"(은행|카드사|고객센터|보안팀|보안\s*팀|담당자|센터)",
        r"(KT|SKT|LGU\+|통신사)",
        r"(카카오|네이버)",
        r"(국세청|홈택스|정부24|행정안전부|고용노동부|근로복지공단|국민연금|국민건강보험|건강보험공단|교육청)",
        r"(검찰|경찰|금감원|금융감독원|국세청|법원|은행|카드사|고객센터)\s*(입니다|안내|연락|통지)",
        r"카드.{0,24}(분실|정지|재발급|발급|신고\s*접수|결제\s*차단)",
    ]),
    ("ctx_contact_move", "메신저/프로필/연락처 이동 유도", "verify", 6, [
        r"(카카오톡|카톡|오픈\s*채팅|오픈채팅|오픈카톡|텔레그램|라인|디스코드|인스타(?:그램)?|DM|디엠|쪽지).*(이동|옮기|전환|넘어오|연락|문의|상담|추가|입장|참여)",
        r"(채널\s*추가|채널추가|친구\s*추가|친추)",
        r"((아이디|ID)\s*(검색|추가|확인)|아이디\s*검색|ID\s*검색|아이디\s*추가|ID\s*추가)",
        r"(프로필).*(확인|조회|눌러|클릭|들어가|접속)",
        r"(오픈\s*채팅|오픈채팅|채팅방|대화방).*(입장|참여|들어오|접속|링크)",
    ]),
    ("threat", "불이익/위협/정지/범죄 프레이밍", "info", 14, [
        r"(정지|차단|불이익|처벌|연체|압류|법적|지급\s*정지|지급정지|계좌\s*동결|통장\s*동결|압류|가압류|영장|체포|구속)",
        r"(범죄|대포\s*통장|대포통장|사건|수사\s*중|압수\s*수색|압수수색)",
    ]),
    ("personalinfo", "개인정보/자격정보 요구", "verify", 20, [
        r"(주민번호|주민\s*등록|신분증|여권|운전면허|면허증|인증서|공인\s*인증서|공동\s*인증서)",
        r"(계정|아이디|id|비밀번호|password)",
        r"(계좌번호|카드번호|보안카드|cvv|cvc)",
        r"(주소|서류\s*사진|신분증\s*사진|사진\s*보내)",
        r"(성함|연락처|전화번호|휴대폰|핸드폰|번호\s*좀)",
    ]),
]

#: Patterns that several cues share.
AMOUNT = r"(\d{1,3}(?:,\d{3})+|\d+)\s*(원|만원)"
OTP_NOUN = r"(인증번호|otp|오티피|승인\s*번호|승인번호|보안\s*코드|보안코드|확인\s*코드|확인코드|ars|2\s*단계\s*인증|6\s*자리|6자리)"
OTP_SHARE = r"(보내|알려|전달|말해|읽어|불러|캡처|말씀)"
TARGET_ACCOUNT = r"(안내\s*계좌|보호\s*계좌|안전\s*계좌|지정\s*계좌).{0,24}(이체|송금|입금|옮기|이전)"

#: Named patterns on one turn's text. A cue with several patterns holds if any matches.
CUES = {
    "otp": [OTP_NOUN],
    "share": [OTP_SHARE],
    "code_noun": [r"(번호|코드|인증|6\s*자리|6자리)"],
    "app_install": [r"(보안\s*앱|인증\s*앱|전용\s*앱|앱|어플|프로그램|문서\s*뷰어|뷰어|viewer|플러그인|plugin).{0,22}(설치|다운로드|받아|깔아|설치해|설치\s*권고|권고\s*드립니다)", r"(팀뷰어|teamviewer|anydesk|애니데스크|퀵서포트|quicksupport)", r"(설치).{0,10}(버튼|button|눌러|누르|클릭)"],
    "remote_phrase": [r"(원격\s*(지원|제어|접속|앱)|화면\s*공유|화면공유)"],
    "install_verb": [r"(설치|다운로드|받아|깔아|실행|연결|접속|등록)"],
    "instead": [r"(대신).{0,10}(입력|처리|인증)"],
    "otp_proxy_noun": [r"(인증번호|otp|오티피|확인\s*코드|확인코드|보안\s*코드|보안코드|6\s*자리|6자리|ars|2\s*단계\s*인증)"],
    "pii_noun": [r"(이름|성함|연락처|전화번호|휴대폰|생년월일|주민등록번호|주민번호|주소|우편번호|계좌번호|카드번호|비밀번호|패스워드|암호|신분증|여권)"],
    "pii_verb": [r"(알려|말해|남겨|적어|입력|작성|보내|제출|올려|전송|사진|캡처)"],
    "finance": [r"(카드|카드사|은행|금융|보안센터|차단센터|분실|해제|승인|결제|해외\s*결제|자동이체|계좌|로그인)"],
    "transfer_word": [r"(입금|송금|이체|납부|지불|충전|선납|보험료)", AMOUNT],
    "escrow": [r"(안전\s*결제|안전\s*거래|에스크로|escrow|거래)"],
    "alert_setting": [r"(결제\s*알림|알림\s*설정|계좌\s*알림|설정\s*변경|설정이\s*변경|설정\s*확인|자동이체\s*등록|자동\s*이체\s*등록|다른\s*기기\s*로그인\s*시도\s*감지|로그인\s*시도\s*감지|접속\s*시도\s*감지)"],
    "link_pay": [r"(링크|페이지|사이트).{0,18}(에서|로).{0,12}(납부|결제|지불|송금|이체|입금)", r"(납부|결제|지불|송금|이체|입금).{0,18}(링크|페이지|사이트)"],
    "directive": [r"(해\s*줘|해줘|해\s*주|해주|해주세요|하세요|하셔야|진행|처리|완료|부탁|요청|바랍니다)"],
    "safe_transfer": [TARGET_ACCOUNT, r"(피해자\s*로\s*분류|자산\s*분리|자산\s*이동|보호\s*조치).{0,24}(계좌|이체|송금|입금|옮기|이전)", r"(자금세탁|범죄자금|수사\s*협조|검찰|경찰|보호센터|수사관|수사팀).{0,40}(계좌|이체|송금|입금|옮기|이전|보호)"],
    "pay_verb": [r"(보내\s*줘|보내줘|부쳐\s*줘|부쳐줘|입금\s*해|입금해|송금\s*해|송금해|이체\s*해|이체해|납부\s*해|납부해|지불\s*해|지불해|충전\s*해|충전해)", r"(입금|송금|이체|납부|지불|충전|선납|보험료).{0,14}(해\s*줘|해줘|해\s*주|해주|해주세요|부탁|요청|하셔야|바랍니다|주시)", r"(납부|지불|결제).{0,14}(하세요|바랍니다|필요|진행|처리|해주세요)", r"(링크|페이지).{0,14}(에서|로).{0,12}(납부|결제|지불)"],
    "pay_in_order_to": [r"결제.{0,10}(하려면|위해|하려고)"],
    "alert_directive": [r"(해\s*주|해줘|해\s*주세요|해주시|부탁|요청|바라|진행|처리\s*해|입금\s*하|송금\s*하|이체\s*하|결제\s*하|납부\s*하|지불\s*하|충전\s*하|보내\s*(줘|주|주세요|바랍니다|바라|주시))"],
    "alert_pay": [r"(입금|송금|이체|결제|납부|지불|충전)"],
    "alert_notice": [r"(알림|안내|내역|확인|승인|거절|취소|환불|시도|차단|보류|접수|완료|처리\s*결과|거래|가맹점|잔액|문자|sms|정기\s*결제|자동\s*이체|자동이체|자동\s*납부|자동납부|해외\s*결제|이상\s*거래|부정\s*사용|승인\s*대기|대기\s*중|대기중)"],
    "family": [r"(엄마|아빠|어머니|아버지|누나|언니|형|오빠|딸|아들|친구|지인)"],
    "device_excuse": [r"(폰|휴대폰|핸드폰|전화).*(고장|분실|바꿨|바꿔|새\s*번호|이\s*번호|번호야)", r"(번호야|새\s*번호|이\s*번호로)"],
    "money_ask": [r"(보내\s*줘|보내줘|이체|송금|입금)"],
    "amount": [AMOUNT],
    "job": [r"(고액\s*알바|알바|재택|해외|현지|동남아|출국|파견|해외\s*근무|해외\s*업무|해외\s*단기|단기\s*고수익|고수익\s*업무|프로젝트\s*인력|인력\s*모집|채용|숙식\s*제공|항공권\s*지원)"],
    "job_wide": [r"(고수익|고액\s*알바|단기\s*알바|단기\s*고수익|당일\s*지급|당일지급|재택\s*알바|초보\s*가능|간단한\s*업무|리뷰\s*알바|댓글\s*알바)"],
    "platform": [r"(오픈\s*채팅|오픈채팅|open\s*chat|openchat|텔레그램|telegram|카카오\s*오픈|오픈\s*카톡|라인|line|디스코드|discord|dm|쪽지|1:1|개인\s*톡)"],
    "move": [r"(이동|입장|초대|링크|추가|문의|연락|대화|채팅|안내)"],
    "place": [r"(방문|내방|출석|출두|집결|모여|오세요|오셔|오시면|오라|와라|와\s*주세요|이동해\s*주세요|지금\s*이동|현장|교육장|면접장|사무실|지점|센터|공항|터미널|역\s*\d*\s*번?\s*출구|출구|주소|오시는\s*길|지도|로비|주차장|층|호)"],
    "visit_verb": [r"(오|오셔|오시면|방문|출석|출두|집결|이동|모여)"],
    "id_ask": [r"(여권|신분증|주민등록증|주민번호|계좌|계좌번호|연락처|전화번호).{0,22}(사진|등록|보내|제출|올려|필요|요청)"],
    "id_mention": [r"(여권|신분증|주민등록증|주민번호|계좌|계좌번호|연락처|전화번호)"],
    "id_need": [r"(필요|요청|등록|제출|선\s*등록|먼저\s*보내)"],
    "fee": [r"(보증금|예치금|가입비|등록비|교육비|수수료|선입금|입회비|예약금|계약금|보안\s*예치)"],
    "fee_verb": [r"(송금|이체|입금|결제|납부|먼저|필요|부탁|내)"],
    "transfer_demand": [r"(이체|송금|입금|결제|납부).{0,20}(해\s*주세요|해주세요|바랍니다|하라|해라|하시|지금|바로)", r"(해\s*주세요|해주세요|바랍니다|하라|해라|지금|바로).{0,20}(이체|송금|입금|결제|납부)"],
    "cash": [r"(현금\s*봉투|현금\s*수거|현금\s*전달|퀵|퀵서비스|대면\s*전달|직접\s*전달|수거|회수)"],
    "cash_verb": [r"(전달|수거|회수|가져오|가져와|보내|받)"],
    "giftcard": [r"(상품권|문화\s*상품권|문상|해피머니|해피\s*머니|구글\s*기프트|google\s*gift|기프트\s*카드|gift\s*card|틴\s*캐시|tincash|핀\s*번호|pin\s*(번호|code)|바코드)"],
    "giftcard_verb": [r"(보내|전달|구매|충전|등록|입력|코드|핀|pin|번호)"],
    "crypto": [r"(가상\s*자산|가상자산|암호\s*화폐|암호화폐|crypto|코인|지갑|wallet|지갑\s*주소|주소|usdt|btc|eth|trc20|erc20|바이낸스|binance|업비트|upbit|빗썸|bithumb)"],
    "crypto_verb": [r"(송금|전송|보내|입금|충전|이체|전달)"],
    "mule": [r"(대포\s*통장|자금\s*세탁|범죄\s*자금|수령\s*대행|수령대행)"],
    "account_lend": [r"(통장|계좌).{0,18}(대여|임대|빌려|양도|사용)"],
    "lend_hook": [r"(수수료|알바|대행|모집|구인)"],
    "qr": [r"(qr\s*코드|qr코드|큐알\s*코드|큐알코드|간편\s*결제|간편결제|페이|토스|카카오\s*페이|kakao\s*pay|네이버\s*페이|naver\s*pay)"],
    "qr_verb": [r"(찍|스캔|scan|결제|송금|이체|입금|진행|처리)"],
    "refund": [r"(환불|환급|취소|해지|구독|정기\s*결제|정기결제|자동\s*결제|자동결제|결제\s*취소)"],
    "refund_verb": [r"(상담|고객센터|문의|링크|url|주소|접속|클릭|안내)"],
    "loan": [r"(대출|대환|저금리|한도|승인|연체|상환)"],
    "loan_verb": [r"(가능|진행|신청|조회|상담|조건|수수료|보증금|선입금|예치금)"],
    "invest": [r"(투자|리딩방|수익|자동\s*투자|코인|주식|단타|vip|체험|정보방|오픈채팅)"],
    "benefit": [r"(지원금|환급|보조금|대상자|대상\s*조회|조회|신청|지급|정부\s*지원|복지)"],
    "benefit_verb": [r"(링크|url|주소|신청|조회|확인|접속|클릭|눌러|입력|등록)"],
    "profile": [r"(카톡|카카오톡|프로필|사진|영상|문서)"],
    "link_word": [r"(링크|url|주소)"],
    "open_verb": [r"(확인|클릭|접속|눌러|열어|들어가)"],
    "biz_doc": [r"(거래처|세금계산서|계산서|견적서|발주서|계약서|회계|정산|invoice|tax\s*invoice|bill|청구서)"],
    "viewer": [r"(뷰어|viewer|문서\s*뷰어|플러그인|plugin)"],
    "fetch_verb": [r"(설치|다운로드|받아|깔아)"],
    "strong_pay": [r"(납부|지불|결제\s*진행|결제\s*해\s*주|결제\s*해주|결제\s*해주세요|납부\s*하세요|송금\s*하세요|이체\s*하세요|입금\s*하세요|충전\s*하세요|수수료\s*입금|선납|보증보험료|보험료)", r"(미납|체납|과태료|벌금|고지|가산금|압류|추심|연체)"],
    "pay_noun": [r"(납부|송금|이체|입금|결제|지불|충전|선납|보험료|수수료|보증금|예치금|가입비|등록비|예약금|계약금|핀\s*번호|상품권|기프트|코인|지갑|qr)"],
    "pay_imperative": [r"(해\s*줘|해줘|해\s*주|해주|해주세요|하세요|하셔야|바랍니다|요청|부탁|필수|반드시|진행|처리|완료)", r"(지금\s*(바로|즉시)|긴급|오늘\s*안에|기한\s*내)"],
    "pressure_word": [r"(긴급|즉시|바로|오늘\s*안에|기한\s*내|반드시|필수)"],
    "arrears": [r"(납부|미납|체납|과태료|벌금|고지|압류|선납|보험료)"],
    "install_cue": [r"(설치|다운로드|앱|어플|프로그램|원격|팀뷰어|anydesk|quicksupport|apk|exe|msi|dmg|pkg|뷰어|viewer|플러그인|plugin)"],
    "install_before_pay": [r"(설치).{0,10}(후|해야|필요).{0,24}(결제|납부|송금|이체|입금|진행)", r"(결제|납부|송금|이체|입금).{0,18}(하려면|위해).{0,18}(설치)"],
    "transfer_request": [r"(보내\s*줘|보내줘|부쳐\s*줘|부쳐줘|입금\s*해|입금해|송금\s*해|송금해|이체\s*해|이체해|납부\s*해|납부해|지불\s*해|지불해|충전\s*해|충전해)", r"(보내|부쳐|송금|이체|입금|납부|지불|충전).{0,14}(해\s*줘|해줘|해\s*주|해주|해주세요|부탁|요청|진행|하셔야|바랍니다|주시)", r"(링크|페이지).{0,14}(에서|로).{0,12}(납부|결제|지불|송금|이체|입금)", r"(납부|결제|지불|송금|이체|입금).{0,12}(하세요|바랍니다|필요|진행)"],
    "stage_pay_word": [r"(납부|송금|이체|입금|지불|충전|선납|보험료)"],
    "verify_cue": [r"(인증|로그인|확인|접속|클릭|눌러|링크|url|주소|입력|작성|제출|전송|보내|캡처|사진)"],
    "intranet": [r"(사내|내부|회사|intranet|인트라넷|내부\s*공지|사내\s*공지|공지\s*페이지|회사\s*it|it\s*팀|helpdesk|헬프데스크|정보보안)"],
    "intranet_unsafe": [r"(otp|인증\s*번호|인증번호|보안\s*코드|보안코드|확인\s*코드|확인코드|ars|2\s*단계\s*인증|2fa|송금|이체|입금|납부|결제|안내\s*계좌|보호\s*계좌|안전\s*계좌|원격|anydesk|quicksupport|teamviewer|apk|설치|다운로드|뷰어|viewer|shortener|bit\.ly|t\.co)"],
    "strong_link": [r"(인증|본인|로그인|계정|비밀번호|otp|오티피|ars|2\s*단계\s*인증|확인\s*번호|확인번호|보안\s*코드|보안코드|확인\s*코드|확인코드|결제|납부|송금|이체|입금|선납|보험료|설치|다운로드|원격|팀뷰어|anydesk|quicksupport|차단|해제|분실|압류|과태료|벌금|미납|체납)"],
    "promo": [r"(쿠폰|기프티콘|설문|프로모션|이벤트|경품|당첨|무료\s*(쿠폰|기프티콘)?)"],
    "scheme_url": [r"https?://[^\s)]+"],
    "otp_relay_demand": [OTP_NOUN + r".*" + OTP_SHARE, OTP_SHARE + r".*" + OTP_NOUN],
    "anti_verify": [r"(대표번호|고객센터|공식\s*번호).{0,20}(확인|전화).{0,20}(하지\s*마|말라)|끊지\s*마|끊으면\s*안\s*돼|다른\s*(채널|경로).{0,20}(쓰지\s*마|금지)|이\s*(링크|앱).{0,20}(로만|에서만|만).{0,10}(진행|처리)"],
    "otp_request": [r"(인증번호|otp).{0,24}(알려\s*줘|알려|말해|보내\s*줘|보내|전달|불러\s*줘|불러|읽어\s*줘|읽어|인증번호\s*줘|코드\s*줘)"],
    "code_request": [r"(승인번호|보안\s*(코드|번호)|보안코드|접속코드|확인코드|인증코드|approval\s*code|verification\s*code|6\s*자리\s*(코드|번호)).{0,40}(알려\s*줘|알려|말해|보내\s*줘|보내|전달|공유|캡처|캡쳐|찍어|스크린샷|화면\s*캡처)"],
    "otp_entry": [r"(인증번호|otp).{0,30}(입력|인증|확인|진행|완료)"],
    "business": [r"(세금계산서|청구서|invoice|인보이스|거래처|견적서|발주서|정산|대금)"],
    "advice": [r"(좋대|추천|권장|제일\s*안전|가장\s*안전|공식\s*고객센터|고객센터\s*번호|문의하는\s*게|문의가\s*안전|안전하게)"],
    "advice_not": [r"(압류|출석|수사|검찰|경찰|기소|체포|고지|미납|체납|과태료|벌금|환급금|대출|선납|보험료)"],
    "denial_after_link": [r"(신청\s*안\s*했|신청\s*한\s*적\s*없|한\s*적\s*없|누른\s*적\s*없|기억\s*없|모르겠|아닌데요|제가\s*아닌데|저\s*아닌데|왜\s*오죠)"],
    "denial_after_otp": [r"(신청\s*안\s*했|신청\s*한\s*적\s*없|한\s*적\s*없|누른\s*적\s*없|기억\s*없|모르겠|아닌데요|제가\s*아닌데|저\s*아닌데|왜\s*오죠|분실\s*신고\s*안|분실\s*접수\s*안|내가\s*아닌|제가\s*아닌)"],
    "otp_demand": [r"(인증번호|otp|오티피|확인\s*코드|보안\s*코드|6\s*자리|6자리|ars|2\s*단계\s*인증)"],
    "it_support": [r"회사\s*it|it\s*지원|공식\s*원격|helpdesk|헬프데스크|사내\s*공지|공지"],
    "now_word": [r"(지금|즉시|바로|긴급|마감|서둘)"],
    "account_notice": [r"(비밀번호\s*재설정|계정\s*(보호|잠김|잠김\s*해제)|로그인\s*시도|다른\s*기기.{0,12}로그인|2\s*단계\s*인증|2fa|보안\s*경고)"],
    "high_pay": [r"(고액|고수익|일당|당일\s*지급|건당|재택|부업|급구)"],
    "self_ack": [r"(제가\s*한\s*건데|제가\s*한\s*거|제가\s*했|내가\s*했|내가\s*한|제가\s*바꿨|내가\s*바꿨|제가\s*변경|내가\s*변경|제가\s*설정\s*바꿨|제가\s*설정했|응\s*내가|맞아\s*내가|내가\s*결제했)"],
    "benign_ack": [r"(확인\s*만|확인만|문제\s*없|정상|제가\s*아닌데|제가\s*한\s*적\s*없|한\s*적\s*없|접수\s*안\s*했|모르겠|아닌데요)"],
    "explicit_pay": [r"(납부|송금|이체|입금|지불|충전|선납|보험료|안내\s*계좌|보호\s*계좌|안전\s*계좌|지정\s*계좌|상품권|문화\s*상품권|문상|핀\s*번호|pin|기프트\s*카드|gift\s*card|usdt|btc|eth|wallet|지갑\s*주소|trc20|erc20|바이낸스|업비트|빗썸)"],
    "alert_thread": [r"(알림\s*설정|설정\s*변경|설정이\s*변경|설정\s*확인|결제\s*알림\s*설정|계좌\s*알림\s*설정|자동이체\s*등록|자동\s*이체\s*등록|다른\s*기기\s*로그인\s*시도\s*감지|로그인\s*시도\s*감지|접속\s*시도\s*감지)"],
    "doc_lure": [r"(세금계산서|거래처|회계팀|인보이스|invoice|견적서|발주서|계약서|정산|반려|수정본|문서\s*(뷰어|viewer)|열람)"],
    "advice_action": [r"(링크|https?://|otp|인증번호|송금|이체|입금|납부|설치|원격|팀뷰어|anydesk|quicksupport)"],
}
#: What a turn that demands, and one that complies, looks like.
DEMAND_PATTERNS = [r"입금해|송금해|이체해|결제해|납부해|지불해|충전해", r"설치해|다운받아|다운로드해|원격|팀뷰어|anydesk|quicksupport", r"(링크|url).*(클릭|눌러)|클릭.*(해|하세요)", r"지금\s*(바로|즉시)|긴급|오늘\s*안에|기한\s*내"]
COMPLY_PATTERNS = [r"^\s*(네|예)\b", r"알겠|알겠습니다|확인했|확인했습니다|확인했어요", r"보냈|전송했|전송했습니다|보냈어요", r"입금했|송금했|이체했|결제했|납부했|충전했", r"설치했|다운받았|다운로드했|클릭했|눌렀", r"(인증번호|otp|오티피|승인\s*번호|보안\s*코드|비밀번호|계좌번호|카드번호|주민번호)"]

#: Fixed sets of identifiers that decide a stage.
INSTALL_HARD = ("apk", "remote", "call_remote", "url_download_ext")
INSTALL_SOFT = ("install_app", "ctx_install_mention")
PAYMENT_ALWAYS = ("ctx_cash_pickup", "ctx_giftcard", "ctx_crypto_wallet", "ctx_account_rental", "ctx_qr_pay")
PAYMENT_CONDITIONAL = ("safe_account", "go_bank_atm", "ctx_transfer_demand", "ctx_payment_request")
PAYMENT_SOFT = ("transfer", "ctx_transfer_phrase", "ctx_pay_with_link")
VERIFY_STRONG = ("otp", "ctx_otp_finance", "ctx_otp_relay", "ctx_otp_proxy", "account_verify", "link", "link_mention", "shortener", "personalinfo", "pii_request")
VERIFY_WEAK = ("messenger_phishing", "ctx_contact_move", "ctx_profile_link_mention", "government_benefit", "ctx_government_benefit", "ctx_visit_place", "ctx_refund_lure", "ctx_loan_hook", "ctx_benefit_link", "ctx_benefit_link_mention")
PRESSURE = ("urgent", "threat", "authority", "ctx_demand", "ctx_secrecy")

#: Fixed values of the prefilter: id -> (points, pattern on lower-case text).
PREFILTER = {
    "pf_safe_account": (32, r"(안전\s*계좌|보호\s*계좌|보호조치\s*계좌|자산\s*이동)"),
    "pf_transfer": (28, r"(송금|이체|입금|결제|납부|보증보험료|수수료\s*입금)"),
    "pf_giftcard": (38, r"(상품권|문화\s*상품권|문상|해피머니|해피\s*머니|구글\s*기프트|google\s*gift|기프트\s*카드|gift\s*card|핀\s*번호|pin\s*(?:번호|code)|바코드)"),
    "pf_crypto": (34, r"(usdt|btc|eth|코인|가상\s*자산|가상자산|암호\s*화폐|암호화폐|crypto|wallet|지갑\s*주소|trc20|erc20|바이낸스|binance|업비트|upbit|빗썸|bithumb)"),
    "pf_account_rental": (36, r"(통장\s*대여|계좌\s*대여|통장\s*임대|계좌\s*임대|대포\s*통장|명의\s*대여|수령\s*대행|수령대행|자금\s*세탁|범죄\s*자금)"),
    "pf_qr_pay": (22, r"(qr\s*코드|qr코드|큐알\s*코드|큐알코드|간편\s*결제|간편결제|토스|카카오\s*페이|kakao\s*pay|네이버\s*페이|naver\s*pay)"),
    "pf_remote": (26, r"(원격|원격지원|팀뷰어|teamviewer|anydesk|quicksupport|화면\s*공유|접속코드)"),
    "pf_otp": (18, r"(인증번호|otp|오티피|2단계\s*인증|보안코드|확인번호|6\s*자리)"),
    "pf_cash_pickup": (40, r"(현금\s*(수거|전달|봉투|뭉치)|현금\s*봉투|퀵|퀵서비스|대면\s*(전달|수거)|기사님\s*(수거|방문)|직접\s*(전달|수거)|택시\s*(수거|전달)|봉투를\s*준비)"),
    "pf_authority": (20, r"(검찰|검찰청|수사관|경찰|경찰청|사이버\s*수사|금감원|금융감독원|금융보안원|국세청|법원|카드사|은행|고객센터)\s*(입니다|안내|연락|통지)"),
    "pf_threat": (20, r"(지급\s*정지|출금\s*정지|거래\s*정지|계좌\s*동결|통장\s*동결|동결\s*조치|압류|가압류|추심|고소|고발|처벌|접속\s*차단|차단\s*예정|계정\s*정지|이용\s*제한|불이익|법적\s*조치|수사\s*대상|영장)"),
    "pf_account_freeze": (20, r"(계좌|통장|거래|출금|카드).{0,20}(동결|정지|중지|차단|잠금|잠김|제한|압류|가압류|지급\s*정지|출금\s*정지|거래\s*정지|사용\s*정지)"),
    "pf_account_verify": (18, r"(이상\s*거래|비정상\s*거래|부정\s*사용|부정\s*결제|명의\s*도용|계좌\s*도용|계정\s*도용|해킹|탈취|침해|로그인\s*(?:시도|차단|제한|이상)|비밀번호\s*(?:변경|초기화|재설정)|계정\s*(?:확인|조회|인증|검증|점검|복구|정지|잠김|잠금|차단|해제)|아이디\s*(?:확인|복구|찾기)?|id\s*(?:확인|복구)?|본인\s*(?:확인|인증)|인증\s*절차|승인\s*내역|결제\s*내역|해외\s*결제)"),
    "pf_urgency": (10, r"(지금|즉시|바로|긴급|오늘\s*안에|기한\s*내|통화\s*끊지\s*마)"),
    "pf_pii": (16, r"(여권|신분증|주민번호|계좌(?:번호)?|카드번호|비밀번호|주소|연락처|이름|인증번호|otp|오티피)\s*(보내|알려|입력|등록|기재|작성|제출|전송|확인)"),
    "pf_link_verbs": (12, r"(링크|url|주소)(?:\s*(?:로|에서|를|에|으로|로써))?(?:.{0,16})?(접속|클릭|눌러|확인|들어가|진행|신청|조회|인증)"),
    "pf_messenger_profile": (8, r"(카톡|카카오톡|카카오\s*톡|카카오|kakao|톡방|채팅방|오픈\s*채팅|오픈채팅|프로필|내\s*프로필|상태\s*메시지|사진|영상|문서|첨부|메신저|메시지|dm|쪽지)"),
    "pf_contact_move": (18, r"(오픈\s*채팅|오픈채팅|open\s*chat|openchat|텔레그램|telegram|카카오\s*오픈|오픈\s*카톡|라인|line|디스코드|discord|1:1|개인\s*톡)"),
    "pf_visit_place": (18, r"(방문|내방|출석|출두|집결|모여|오세요|오셔|오시면|이동해\s*주세요|현장|교육장|면접장|사무실|지점|센터|공항|터미널|역\s*\d*\s*번?\s*출구|출구|주소|오시는\s*길|지도|로비|주차장|층|호)"),
    "pf_job_hook": (10, r"(고수익|고액|단기|알바|아르바이트|재택|부업|당일\s*지급|초보\s*가능|모집|구인|급구)"),
    "pf_otp_demand": (22, r"(인증번호|otp|오티피).*(보내|알려|불러|읽어|전달|캡처|스크린샷|입력)"),
    "pf_benefit_hook": (12, r"(지원금|보조금|환급|환불|재난\s*지원금|민생\s*지원금|소상공인\s*지원|근로\s*장려금|자녀\s*장려금|청년\s*지원|대상자\s*(?:조회|확인)|신청\s*(?:가능|대상)|미수령|추가\s*지급|정부\s*24|gov\s*24|gov24)"),
}
PREFILTER_BENEFIT_LINK = (18, r"(링크|url|주소|https?://|www\.|hxxp|\[\.\])")
PREFILTER_BENEFIT_PII = (20, r"(계좌|카드|비밀번호|주민번호|신분증|본인\s*인증|로그인|인증번호|otp|오티피|입력|등록)")
PREFILTER_SOFT, PREFILTER_AUTO, PREFILTER_LINES = 28, 52, 16

#: Cues that are asked of the whole thread, whoever speaks.
THREAD_CUES = (
    "anti_verify", "otp_request", "code_request", "otp_entry", "business", "advice", "advice_not", "advice_action", "it_support", "now_word", "account_notice",
    "high_pay", "self_ack", "benign_ack", "explicit_pay", "alert_thread", "doc_lure",
)
#: Labels of hosts that are a company's own.
INTERNAL_HOST = r"(^|\.)(intranet|internal|corp|portal|servicenow|jira|confluence)(\.|$)"
#: Flag -> identifiers of hits.
RISK_FLAGS = {
    "remote": ("remote", "call_remote"), "otp": ("otp", "call_otp", "ctx_otp_relay"), "first": ("call_first_contact",), "apk": ("apk", "url_download_ext", "install_app"),
    "linked": ("link", "shortener", "link_mention", "ctx_profile_link_mention"), "installed": ("ctx_install_mention", "install_app", "apk", "remote", "url_download_ext"),
    "mention": ("ctx_install_mention",), "demand": ("ctx_demand", "ctx_comply_after_demand", "ctx_otp_relay"), "otp_finance": ("ctx_otp_finance", "ctx_otp_proxy", "ctx_denial_after_otp"),
    "pii": ("pii_request", "personalinfo"), "authority": ("authority",), "threat": ("threat",), "urgent": ("urgent", "call_urgent"),
    "transfer": ("go_bank_atm", "transfer", "safe_account", "ctx_transfer_phrase"), "asked": ("ctx_payment_request", "ctx_pay_with_link"),
    "transfer_demand": ("ctx_transfer_demand",), "cash": ("ctx_cash_pickup",), "visit": ("ctx_visit_place",), "alert": ("txn_alert",), "job": ("job_lure", "ctx_job_hook"),
    "job_scam": ("ctx_job_scam",), "family": ("ctx_family_scam",), "invest": ("invest_lure", "ctx_investment_link"), "move": ("ctx_contact_move",), "secrecy": ("ctx_secrecy",),
    "malicious": ("messenger_phishing", "url_malicious", "ctx_url_malicious"), "money": ("go_bank_atm", "safe_account", "ctx_transfer_phrase"), "called": ("call_otp", "call_remote"),
}
