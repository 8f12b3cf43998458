"""A small table of lines with personal data marked by hand, to train and to measure the field on.

Marks are ``[kind|value]``. All values are invented. Lines without marks hold what must be left alone: dates, prices, versions,
order numbers, checksums of files that are named as such.
"""

from __future__ import annotations

import re

# Lines as they were labelled.
LINES = r"""
Please write to [email|anna.keller@post.example.org] before Friday.
Contact: [email|j_smith+news@mail.example.com], phone [phone|+44 20 7946 0958].
Ansprechpartner ist [email|k.huber@amt.example.de].
the list owner ([email|owner-17@lists.example.net]) did not answer
reply-to [email|no.reply@shop.example.co.uk] or visit the desk
Mande un correo a [email|maria99@correo.example.es] y espere.
Écrivez à [email|service@aide.example.fr] pour plus de détails
from [email|x1@y2.example.io] to [email|z3@y2.example.io], twice
our server [ip|192.168.10.4] was down for 12 minutes
login from [ip|203.0.113.77] at 10:42
ping [ip|10.0.0.1], then [ip|10.0.0.254]; version 2.4.1 is fine
Der Rechner [ip|172.16.254.3] antwortet nicht
la direccion [ip|198.51.100.23] fue bloqueada
and then [ip|8.8.4.4] of the others was seen
blocked hosts: [ip|203.0.113.5] [ip|203.0.113.6] [ip|203.0.113.7]
paid with [card|4539 1488 0343 6467] on 3 May
card number [card|6011000990139424] was declined
Karte [card|5500-0055-5555-5559], gültig bis 04/27
the house [card|4485275742308327] of the old
tarjeta [card|3566002020360505] en la tienda
numéro [card|4716 1089 9971 6531] refusé par la banque
where thing [card|2720992593319364], over there
word [card|5105105105105100] and [card|4111111111111111] again
call [phone|+1 (212) 555-0147] after six
Tel. [phone|+49 30 901820] oder [phone|+49 (89) 2180-0]
you may ring [phone|+1 (309) 555-7741] of the house
llame al [phone|+34 91 123 45 67] por la tarde
appelez le [phone|+33 1 70 18 99 00] demain
the [phone|+1 (415) 555-0199] line, and that was all
fax: [phone|(212) 555-0188], room 12
my number is [phone|(030) 9018-2211] at work
ring [phone|(617) 555-0123] or come by
office [phone|(415) 555-2671] until five
token = "[secret|9f86d081884c7d659a2feaa0c55ad015a3bf4f1b]"
TOKEN = "[secret|2C26B46B68FFC68FF99B453C1D30413413422D70]"
api_key = "[secret|5e884898da28047151d0e56f8dc6292773603d0d]" # do not share
the token = "[secret|6b86b273ff34fce19d6b804eff5a3f5747ada4ea]" of the house
AND TOKEN = "[secret|D4735E3A265E16EEE03F59718B9B5D03019C07D8]" WAS THERE
key: [secret|4e07408562bedb8b60ce05c1decfe3ad16b72230967de01f]
secret='[secret|4B227777D4DD1FC61C6F884F48641D02B4D121D3]'
export ACCESS_KEY = [secret|EF2D127DE37B942BAAD06145E54B0C619A1F22327B2EBBCFBEC78F5564AFE39D]
auth: "[secret|e7f6c011776e8db7cd330b54174fd76f7d0216b6]", user: "guest"
password hash [secret|7902699be42c8a8e46fbbb4501726517e86b22c5] was leaked
und token = "[secret|19581e27de7ced00ff1ce50b2047e7a567c76b1c]" ist geheim
el token = "[secret|4a44dc15364204a80fe80e9039455cc1608281820]" es secreto
le TOKEN = "[secret|4FC82B26AECB47D2868C4EFBE3581732A3E7CBCC]" est secret
passed [secret|6f4b6612125fb3a0daecd2799dfd6c9c299424fd]### over
SECRET "[secret|785F3EC7EB32F30B90CD0FCF3657D388B5FF4297]"!! GONE!!
session [secret|b17ef6d19c7a5b1ee83b907c595526dcb1eb06db8227d650d5dda0a9f4ce8cd9] closed
the report of 2021-04-17 lists 1,204 cases in 37 towns
version 3.12.4 replaces 3.11.9 and 2.0.0.1 of the tool
room 214, floor 3, open 9:00-17:30
it cost 1,299.00 instead of 1499.50, or 12 a month
chapter 4.2.1 on page 118 and figure 7
in 1998 they had 12 of 40, in 2003 only 3
order 20240117-0042 was shipped on 18.01.2024
ISBN 978-3-16-148410-0 is out of print
the ratio is 0.6180339887 to 1
Licensed under the terms of version 2.0, January 2004.
copies 1-5 and 7-12 are missing, see note 3
am 24.12. um 18:30 Uhr, Eintritt 5 Euro
cerca de 3.500 personas en 1492 y 1810
environ 2 500 habitants en 1789, 3 200 en 1815
flight 1182 leaves at 06:55 from gate B12
ratio 16:9, 1920x1080, 60 Hz, 24 bit
see RFC 2616 section 14.9 and table 3
the 3rd of 4 parts; 100% of 250 g
and then the old house was over there, again and again
Die Straße ist lang, und das Haus ist alt (siehe oben).
la casa es vieja; el perro duerme
THE OTHERS WERE NOT THERE!! NOBODY!! KNEW!!
x = y + 1; z = x * 2 # no secret here
a "quoted word" and 'another one', nothing else
"""

_MARK = re.compile(r"\[(email|ip|card|phone|secret)\|([^\]]*)\]")


def labelled_lines() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``(line, spans)`` of the table."""
    found = []
    for marked in LINES.strip().split("\n"):
        text, spans, at = "", [], 0
        for mark in _MARK.finditer(marked):
            text += marked[at:mark.start()]
            spans.append((mark[1], len(text), len(text) + len(mark[2])))
            text += mark[2]
            at = mark.end()
        found.append((text + marked[at:], spans))
    return found
