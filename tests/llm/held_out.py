"""Texts that were not written by the generator of the test tables, with what is in them: (text, [(kind, mention)])."""

CASES = [
    ("Reach out to priya.n@contoso-mail.com when you land", [("email", "priya.n@contoso-mail.com")]),
    ("my address for invoices: billing+eu@shop.example.co.uk", [("email", "billing+eu@shop.example.co.uk")]),
    ("jane (at) example dot com", [("email", "jane (at) example dot com")]),
    ("jane [at] example.com, please", [("email", "jane [at] example.com")]),
    ("write tоm@мail.ru today", [("email", "tоm@мail.ru")]),
    ("联系 jane 艾特 example 点 com", [("email", "jane 艾特 example 点 com")]),
    ("email jane at example.com", [("email", "jane at example.com")]),
    ("schreib an otto klammeraffe beispiel punkt de", [("email", "otto klammeraffe beispiel punkt de")]),
    ("écrivez à luc arobase exemple point fr merci", [("email", "luc arobase exemple point fr")]),
    ("ｔｅｓｔ＠ｅｘａｍｐｌｅ．ｏｒｇ is full width", [("email", "ｔｅｓｔ＠ｅｘａｍｐｌｅ．ｏｒｇ")]),
    ("x_y-z@sub.domain.io; a@b.cc", [("email", "x_y-z@sub.domain.io"), ("email", "a@b.cc")]),
    ("jo​hn@exa​mple.com hides", [("email", "jo​hn@exa​mple.com")]),
    ("call me on 555 one two three four", [("phone", "555 one two three four")]),
    ("ring double five one two three four five on my phone", []),
    ("phone double five one two three four five", [("phone", "double five one two three four five")]),
    ("mobile +𝟒𝟒 𝟐𝟎 𝟕𝟗𝟒𝟔 𝟎𝟗𝟓𝟖", [("phone", "+𝟒𝟒 𝟐𝟎 𝟕𝟗𝟒𝟔 𝟎𝟗𝟓𝟖")]),
    ("phone ٠٢٠ ٧٩٤٦ ٠٩٥٨", [("phone", "٠٢٠ ٧٩٤٦ ٠٩٥٨")]),
    ("phone ②⓪⑦ 946 0958", [("phone", "②⓪⑦ 946 0958")]),
    ("tel. (415) 555-0132 ext. 7", [("phone", "(415) 555-0132 ext. 7")]),
    ("Rufen Sie 030 901820 an oder +49 (0)30 901820", [("phone", "030 901820"), ("phone", "+49 (0)30 901820")]),
    ("appelez le 01 44 55 66 77 avant midi", [("phone", "01 44 55 66 77")]),
    ("手机：13800138000", [("phone", "13800138000")]),
    ("电话 一三八零零一三八零零零", [("phone", "一三八零零一三八零零零")]),
    ("WhatsApp +34 612 345 678", [("phone", "+34 612 345 678")]),
    ("oh seven seven oh one four six eight nine one eight is my mobile", [("phone", "oh seven seven oh one four six eight nine one eight")]),
    ("SSN 078-05-1120 on file", [("id_number", "078-05-1120")]),
    ("passport number K12345678 expires soon", [("id_number", "K12345678")]),
    ("身份证 11010519491231002X", [("id_number", "11010519491231002X")]),
    ("My National Insurance number is QQ 12 34 56 C", [("id_number", "QQ 12 34 56 C")]),
    ("Steuer-ID: 47 036 892 816", [("id_number", "47 036 892 816")]),
    ("numéro de sécurité sociale 2 84 05 75 123 456 32", [("id_number", "2 84 05 75 123 456 32")]),
    ("Reisepass C01X00T47", [("id_number", "C01X00T47")]),
    ("tax id 912-70-1234", [("id_number", "912-70-1234")]),
    ("trace id 078051120 and build 4711-22-9999 passed", []),
    ("I moved to 221B Baker Street, London NW1 6XE", [("address", "221B Baker Street, London NW1 6XE")]),
    ("ship to 1600 Amphitheatre Parkway, Mountain View", [("address", "1600 Amphitheatre Parkway, Mountain")]),
    ("Sie wohnt Hauptstraße 12, 10115 Berlin", [("address", "Hauptstraße 12, 10115 Berlin")]),
    ("Lieferung: Unter den Lindenallee 5", [("address", "Unter den Lindenallee 5")]),
    ("14 rue de la Paix, 75002 Paris", [("address", "14 rue de la Paix, 75002 Paris")]),
    ("vive en Calle Mayor 5, Madrid", [("address", "Calle Mayor 5, Madrid")]),
    ("abita in Via Garibaldi 18, Torino", [("address", "Via Garibaldi 18, Torino")]),
    ("我家在中山路88号3栋", [("address", "中山路88号3栋")]),
    ("Flat 4, 12 Elm Close", [("address", "Flat 4, 12 Elm Close")]),
    ("350 Fifth Ave, New York, NY 10118", [("address", "350 Fifth Ave, New")]),
    ("the street is closed and the road 66 plan is old", []),
    ("We met in Vienna near the old market", []),
    ("I am Priya Natarajan and new here", [("name", "Priya Natarajan")]),
    ("My name is Ahmed Al-Rashid.", [("name", "Ahmed Al-Rashid")]),
    ("Signed, Chidi Okafor", [("name", "Chidi Okafor")]),
    ("Dr. Yamamoto will call", [("name", "Dr. Yamamoto")]),
    ("Ich bin Jürgen Krause aus Ulm", [("name", "Jürgen Krause")]),
    ("je m'appelle Élodie Fournier", [("name", "Élodie Fournier")]),
    ("Kind regards, Sofia Lindqvist", [("name", "Sofia Lindqvist")]),
    ("assigned to Kofi Mensah yesterday", [("name", "Kofi Mensah")]),
    ("我叫欧阳明，来自上海", [("name", "欧阳明")]),
    ("Frau Weber hat angerufen", [("name", "Frau Weber")]),
    ("Ask Mrs. O'Connor about it", [("name", "Mrs. O'Connor")]),
    ("Velric Ashby wrote the note", [("name", "Velric Ashby")]),
    ("thanks to Tomás Herrera for the fix", [("name", "Tomás Herrera")]),
    ("Lars and Mette Sørensen joined", [("name", "Mette Sørensen")]),
    ("Project Falcon and Operation Blue Moon start Monday", []),
    ("The New Release of Spark Core ships in Q3", []),
    ("version 1.2.3 at commit deadbeef, 12:30 on 2026-05-01", []),
    ("order 1234567 of batch 99 took 15 ms", []),
    ("the failure at module.py line 42, see docs at intro.md", []),
    ("two or three of four or five, six at most", []),
    ("pip install tool@1.2.3 and npm i @scope/pkg", []),
    ("price 1.299,00 EUR per 1000 units", []),
    ("第12号文件和3楼会议室", []),
    ("Call the API at /v1/users with token abc", []),
]
