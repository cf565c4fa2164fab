"""The small labelled table that the field over word shapes is trained on.

One row per line; [kind words] marks personal data. Invented for this purpose.
"""

ROWS = """
Write to [email jo.smith@example.org] before noon .
Send it to [email anna_b@mail.example.com] , please .
My address is [email k.lee at example dot com] these days
reach me : [email peter (at) example (dot) org] or by post
mail [email info [at] shop.example [dot] net] for the list
contact [email maria.lopez AT example DOT com] today
questions to [email t.berg@ example.com] only
You find [email support @ example.org] on the page .
She wrote from [email x99@test.example.net]; he did not .
the old one was [email ben at mail dot example dot com] until May
We met at noon and ate at the inn .
Look at the dot on the map at home .
He was at work at nine , she at ten .
put a dot at the end of the line
The dot stands at the left .
Call [phone +1 (437) 555-0689] now .
Phone : [phone (325) 555-8094] after five
tel. [phone 020 7946 0018] or ask at the desk
Ring [phone 555-867-5309] and wait .
my number is [phone 0049 30 1234567] at home
fax [phone (030) 123-4567] , second floor
Call me on [phone 437-555-0123] please
dial [phone 1-800-555-0199] for help
mobile [phone 07700 900123] until six
number [phone 437.555.0186] is mine
reach us at [phone 202 555 0143] or write
Tel [phone +49 30 901820] , room 5
Card [card 4111 1111 1111 1111] was used .
paid with [card 5500-0000-0000-0004] last week
card no. [card 340000000000009] , thanks
The number [card 4012888888881881] is on the slip
charge [card 6011 0009 9013 9424] today
visa [card 4222-2222-2222-2] expired
Host [ip 192.168.10.4] did not answer .
from [ip 10.0.0.17] to [ip 10.0.0.18] in one hop
ping [ip 172.16.254.1] failed
the server [ip 203.0.113.77] is down
login by [ip 198 . 51 . 100 . 23] refused
address [ip 192.0.2[.]44] was blocked
Version 2.0 of the licence applies .
In 1998 there were 250 rooms and 12 halls .
On 12.03.2021 he paid 1,200.50 in cash .
Chapter 3 , page 114 , line 7 .
The sum of 3 and 4 is 7 .
From 9:30 to 17:45 on 5 days a week
rows 10 - 20 and 35 - 40 of table 6
pi is 3.14159 and e is 2.71828
item 100234 costs 19.99 per piece
Order 55-1203 came on 2020-11-05 .
see section 4.2.1 and figure 12b
built 1850-1910 , closed 1975
scores of 3-2 , 1-0 and 4-4
ISBN 978-3-16 in 2nd print
released as v1.12.3 on Monday
MIT License , Copyright 2019 , all rights reserved .
key = ab12cd34ef56 ; value = 77
AB-1234 and CD-5678 were parked
id 0x1f3a 0x77b2 at row 18
Wh ea thonand , the ertion of heand .
The thinges oner anst and whor the .
Éè entre le la mentque , de un ou .
Der einung und verlich , zu im ge .
Ción la de que ado , mente los y .
OF!! THE!! AND!! TION!! AN!!
and&&& the*** of%%% ing### to$$$
ate | the | ing | ond | ere |
Home | About | Contact | Terms
1 . 2 . 3 . 4 . list of points
a b c d e f g h i j k
Up 5 % in 2022 and 7 % in 2023 .
24 of 90 pupils passed , 66 did not .
at 40 degrees for 30 minutes at least
(c) 2014 The Authors . All rights reserved .
http://www.example.com/page/12 is the link
see www.example.org or ask
"""
